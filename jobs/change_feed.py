"""A daily feed of what changed in which note, for readers that weren't there when it happened.

Notification files arrive in a folder. A file stream takes those that it hasn't taken yet (its checkpoint knows which),
turns them into changes of notes, and adds them to a log by batch and day. The days that a batch has changes of are
then made anew from the log: changes of a note in short succession are one entry. So late changes find their way into
the day they belong to, however late, and a batch that is repeated after a failure writes the same files again.

    python -m jobs.change_feed jobs/change_feed.toml

Work grows with what is new and the days that it belongs to. The log is written where the changes were read, without a
shuffle. Entries end at midnight; changes without a time stay in the log, under no day, and aren't in the feed.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs._run import main, overwrite, read_if_there
from quillspark.sources.adapters import notifications
from quillspark.streaming.changes import bursts, translate

LOG = "vault string, path string, action string, ts timestamp_ntz, batch long, day date"
FEED = "vault string, path string, action string, merged long, first timestamp_ntz, last timestamp_ntz, day date"
log = logging.getLogger("change_feed")


def run(spark: SparkSession, source: str, out: str, checkpoint: str, gap_ms: int = 500, files_per_batch: int = 1000) -> None:
    """Brings the feed (out/feed, by day) up to the notification files in source; changes are kept in out/log."""
    kept, feed = f"{out.rstrip('/')}/log", f"{out.rstrip('/')}/feed"

    def take(batch: DataFrame, n: int) -> None:
        read, wrote = Observation(), Observation()
        seen = batch.observe(read, F.count("*").alias("rows"))
        found = translate(notifications(seen)).withColumn("batch", F.lit(n)).withColumn("day", F.to_date("ts"))
        overwrite(found.observe(wrote, F.count("*").alias("rows")), kept, "batch", "day")
        entries = _entries(spark, kept, n, gap_ms)
        if entries is not None:
            overwrite(entries.hint("rebalance", "day"), feed, "day")
        log.info("batch %d: read %d notifications of %s, wrote %d changes to %s and their days to %s", n, read.get["rows"], source, wrote.get["rows"], kept, feed)

    schema = spark.read.parquet(source).schema
    at = source.rstrip("/")
    pattern = f"{at[:-1]}[{at[-1]}]"  # a file stream takes a folder or a pattern; this one names a file as well
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%s is up to date", feed)


def _entries(spark: SparkSession, kept: str, n: int, gap_ms: int) -> DataFrame | None:
    """The feed of the days that batch n has changes of; None if there are none. Days are partitions, a few a batch."""
    changes = read_if_there(spark, kept, LOG)
    days = [r[0] for r in changes.where((F.col("batch") == n) & F.col("day").isNotNull()).select("day").distinct().collect()]
    if not days:
        return None
    return bursts(changes.where(F.col("day").isin(days)), gap_ms, ["vault", "path", "day"]).select(*[c.split()[0] for c in FEED.split(", ")])


def read(spark: SparkSession, out: str) -> DataFrame:
    """The whole feed."""
    return read_if_there(spark, f"{out.rstrip('/')}/feed", FEED)


if __name__ == "__main__":
    main("change_feed", run)
