"""Change events in the order they happened, and readers of them that don't wait for each other.

Events of a vault are numbered from 1 and appended in batches, one partition each, so that a batch that is repeated
replaces itself. A reader keeps the number of the last event that it has had of each vault. The log is read back
`capacity` events at most: a reader that has fallen further behind is told how many it missed, and goes on with those
that are left.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.plans.catalog import Catalog
from quillspark.streaming.changes import as_lines

EVENTS = "seq long, type string, event_type string, path string, content_hash string, detected_at string, vault string, batch long"
#: What a reader gets: events, and control events in their place.
TOLD = ["type", "event_type", "vault", "path", "content_hash", "missed", "action", "detected_at"]
CAPACITY = 256


def after(log: DataFrame, offsets: dict[str, int], capacity: int = CAPACITY) -> DataFrame:
    """vault, seq and TOLD: the events of the vaults in offsets that come after those numbers, in order; where some are
    out of reach, one of type stream_lagged comes in the place of the last one missed."""
    spark = log.sparkSession
    had = F.broadcast(spark.createDataFrame(list(offsets.items()), "vault string, had long"))  # a reader's vaults
    own = log.where(F.col("vault").isin(list(offsets)))
    newest = own.groupBy("vault").agg(F.max("seq").alias("newest"), F.max("detected_at").alias("detected_at"))  # a row a vault
    kept = newest.join(had, "vault").withColumn("first", F.greatest("had", F.col("newest") - capacity))
    events = own.join(F.broadcast(kept.select("vault", "first")), "vault").where(F.col("seq") > F.col("first"))
    events = events.select("vault", "seq", "type", "event_type", "path", "content_hash", F.lit(None).cast("long").alias("missed"), F.lit(None).cast("string").alias("action"), "detected_at")
    none = F.lit(None).cast("string")
    lag = kept.where(F.col("first") > F.col("had")).select(
        "vault", F.col("first").alias("seq"), F.lit("stream_lagged").alias("type"), none.alias("event_type"), none.alias("path"), none.alias("content_hash"),
        (F.col("first") - F.col("had")).alias("missed"), F.lit("resync_required").alias("action"), "detected_at",
    )
    return lag.unionByName(events).select("seq", *TOLD)


@dataclass
class EventLog:
    spark: SparkSession
    path: str
    capacity: int = CAPACITY

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(EVENTS).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], EVENTS)

    def newest(self, vaults: list[str]) -> dict[str, int]:
        """The number of each vault's last event, 0 if it has none."""
        found = self.read().where(F.col("vault").isin(vaults)).groupBy("vault").agg(F.max("seq")).collect()  # a row a vault
        return dict.fromkeys(vaults, 0) | {r[0]: r[1] for r in found}

    def append(self, events: DataFrame, vault: str, batch: int) -> None:
        """Adds a batch's events of one vault (bounded by the stream's limit), by path."""
        before = self.read().where((F.col("vault") == vault) & (F.col("batch") < batch)).agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        place = F.row_number().over(Window.orderBy("path")) + F.lit(before)
        put = events.withColumn("seq", place.cast("long")).withColumn("batch", F.lit(batch).cast("long"))
        put.select(*[c.split()[0] for c in EVENTS.split(", ")]).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("vault", "batch").parquet(self.path)

    def subscribe(self, catalog: Catalog, token: str | None = None) -> Subscription:
        """A reader of what happens from now on in one vault, which must be active, or in those that are active now."""
        return Subscription(self, self.newest(catalog.subscribe(token)))


@dataclass
class Subscription:
    log: EventLog
    offsets: dict[str, int] = field(default_factory=dict)

    def poll(self) -> list[dict]:
        """What has happened since the last call: at most the log's capacity for each vault, and a lag event."""
        if not self.offsets:
            return []
        got = [r.asDict() for r in after(self.log.read(), self.offsets, self.log.capacity).orderBy("vault", "seq").collect()]
        for r in got:
            self.offsets[r["vault"]] = max(self.offsets[r["vault"]], r["seq"])
        return got

    def lines(self) -> DataFrame:
        """The same as JSON, a line each, without advancing."""
        return as_lines(after(self.log.read(), self.offsets, self.log.capacity).orderBy("vault", "seq").select(*TOLD))
