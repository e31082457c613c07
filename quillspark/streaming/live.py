"""A vault's changes as they happen: notifications, index and events, batch by batch.

A stream's clock ticks (Spark's own rate source). At each tick the vault's folder is listed, without its texts, and
compared by size and time with the index's list of files; what differs is a notification. At most `limit` of them are
taken, in the order of paths, and the others are found again at the next tick, so a burst fills no queue. Only files
that changed since the oldest of those taken are opened. The index is brought up to date, then events are logged.

What a batch is about to do is written down first. A batch that is repeated after a failure does just that again, so
each change is one event, also if the failure came between the index and the log.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.errors import EngineError
from quillspark.functions.embed import Embedder
from quillspark.operators.diff import same_stat
from quillspark.plans import engine
from quillspark.sources.snapshot import Snapshots
from quillspark.sources.vaults import TIME, walk
from quillspark.streaming.changes import apply_batch, events
from quillspark.streaming.event_log import CAPACITY, EventLog

PLANNED = "vault string, path string, effect string, content_hash string, previous_hash string, size long, mtime string, content string, detected_at string, batch long"
_FILES = "vault string, path string, size long, mtime string, content_hash string, indexed_at string, content string"


def notifications(listing: DataFrame, files: DataFrame) -> DataFrame:
    """vault, path, action: files to look at (new ones, those of another size or time, those to be made anew) and files
    that are gone, for a listing (vault, path, size, mtime) against the index's files.

    One join finds both. A union of two shuffled joins counts as dealt by vault and path in Spark 4.1, and a join or sum
    over it then fails by unequal numbers of partitions.
    """
    look = ~F.coalesce(same_stat("d", "f"), F.lit(False))
    d, f = listing.select("vault", "path", "size", "mtime", F.lit(True).alias("there")).alias("d"), files.select("vault", "path", "size", "mtime", "content_hash").alias("f")
    j = d.join(f, (F.col("d.vault") == F.col("f.vault")) & (F.col("d.path") == F.col("f.path")), "full_outer").where(F.col("d.there").isNull() | look)
    action = F.when(F.col("d.there").isNull(), "remove").otherwise("upsert").alias("action")
    return j.select(F.coalesce("d.vault", "f.vault").alias("vault"), F.coalesce("d.path", "f.path").alias("path"), action)


@dataclass
class Live:
    """A vault whose folder is watched. work: a folder of the vault's own for checkpoints and plans of batches."""

    snapshots: Snapshots
    log: EventLog
    vault: str
    folder: str
    work: str
    limit: int = CAPACITY
    embed: Embedder | None = None
    dims: int = 64
    tries: int = 20  # times that a commit is tried again after another writer's
    walk_options: dict = field(default_factory=dict)

    def _known(self) -> DataFrame:
        spark = self.snapshots.spark
        return spark.createDataFrame([], _FILES) if self.snapshots.current() is None else self.snapshots.read("files", [self.vault])

    def _listed(self) -> DataFrame:
        return walk(self.snapshots.spark, self.vault, self.folder, content=False, **self.walk_options)

    def waiting(self) -> DataFrame:
        """The notifications that no batch has taken yet."""
        return notifications(self._listed(), self._known())

    def _plan(self, batch: int) -> DataFrame | None:
        """What the batch does: as written down if it has begun before, else from the folder; None if there's nothing."""
        spark, path = self.snapshots.spark, f"{self.work}/planned"
        try:
            if (had := spark.read.schema(PLANNED).parquet(path).where(F.col("batch") == batch)).take(1):
                return had
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        listed = self._listed()
        chosen = [tuple(r) for r in self.waiting().orderBy("path").limit(self.limit).collect()]
        if not chosen:
            return None
        told = spark.createDataFrame(chosen, "vault string, path string, action string")
        oldest = listed.join(F.broadcast(told), ["vault", "path"], "left_semi").agg(F.min(F.to_timestamp("mtime", TIME))).first()[0]
        # no file to open has a time before the oldest of those chosen
        found = walk(spark, self.vault, self.folder, since=F.lit(oldest), **self.walk_options).join(F.broadcast(told.where("action = 'upsert'")), ["vault", "path"], "left_semi")
        with self.snapshots.staged(found) as texts:  # read once: a later look could find other bytes
            changes = apply_batch(told.withColumn("ts", F.lit(0)), self._known(), texts)
            rows = changes.join(texts.select("vault", "path", "size", "mtime", "content"), ["vault", "path"], "left")
            now = F.date_format(F.current_timestamp(), TIME)
            rows.withColumn("detected_at", now).withColumn("batch", F.lit(batch).cast("long")).select(*[c.split()[0] for c in PLANNED.split(", ")]).write.mode("overwrite").parquet(path)
        return spark.read.schema(PLANNED).parquet(path)

    def tick(self, batch: int) -> None:
        plan = self._plan(batch)
        if plan is None:
            return
        at = plan.select("detected_at").first()[0]
        for tries in range(self.tries, -1, -1):
            try:
                engine.update(self.snapshots, self.vault, plan.where("effect <> 'deleted'"), plan.where("effect = 'deleted'"), at, self.embed, self.dims)
                break
            except EngineError as e:  # another vault's writer came first
                if e.code != "conflict" or not tries:
                    raise
                time.sleep(0.2)
        self.log.append(events(plan, F.lit(at)), self.vault, batch)

    def start(self, **trigger) -> StreamingQuery:
        """The stream; trigger as writeStream has it, by default every half second."""
        spark = self.snapshots.spark
        clock = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
        return clock.writeStream.foreachBatch(lambda _, n: self.tick(n)).option("checkpointLocation", f"{self.work}/checkpoint").trigger(**(trigger or {"processingTime": "500 milliseconds"})).start()

    def drain(self, seconds: float = 1.0) -> bool:
        """After the stream's stop: takes what still waits, batch by batch, until the time is up. Was that all?"""
        until = time.monotonic() + seconds
        while self.waiting().take(1):
            if time.monotonic() > until:
                return False
            self.start(availableNow=True).awaitTermination()
        return True
