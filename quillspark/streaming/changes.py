"""Live changes: raw notifications to index changes and events, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators.diff import scan_diff
from quillspark.sources.vaults import IGNORED, included, watched

EVENTS = {"inserted": "created", "updated": "modified", "deleted": "deleted"}


def translate(raw: DataFrame, folders: dict[str, str] | None = None, ignore: list[str] | None = None, gitignores: dict[str, str] | None = None) -> DataFrame:
    """vault, path, action (upsert or remove), ts for raw (vault, kind, rename_mode, paths, ts).

    A rename from one path to another is a removal and an upsert; other renames are upserts; notices of access or
    metadata are dropped, and so are paths that no index holds.

    folders: each vault's folder, where raw has whole paths; paths outside it are dropped. Without, they lie in it
    already. ignore, gitignores: as `walk` has them.
    """
    p = F.col("paths")
    one = lambda action, i: F.struct(F.get(p, F.lit(i)).alias("path"), F.lit(action).alias("action"))
    kind = F.lower("kind")
    actions = (
        F.when((kind == "rename") & (F.lower("rename_mode") == "both"), F.array(one("remove", 0), one("upsert", 1)))
        .when((kind == "rename") & (F.lower("rename_mode") == "from"), F.array(one("remove", 0)))
        .when(kind == "remove", F.transform(p, lambda x: F.struct(x.alias("path"), F.lit("remove").alias("action"))))
        .when(kind.isin("create", "modify", "rename"), F.transform(p, lambda x: F.struct(x.alias("path"), F.lit("upsert").alias("action"))))
    )
    found = raw.select("vault", F.explode(actions).alias("a"), "ts").select("vault", "a.path", "a.action", "ts")
    if folders is not None:
        at = F.create_map(*[F.lit(x) for v, f in folders.items() for x in (v, f.rstrip("/") + "/")]) if folders else F.lit(None).cast("map<string,string>")
        found = found.withColumn("root", at[F.col("vault")]).where(F.col("path").startswith(F.col("root"))).withColumn("path", F.expr("substring(path, length(root) + 1)")).drop("root")
    path = F.col("path")
    return found.where(watched(path) & included(path, list(IGNORED) if ignore is None else ignore, gitignores))


def debounce(changes: DataFrame, gap: str, key: list[str] = ("vault", "path"), value: str = "action") -> DataFrame:
    """The last value of each burst: changes of a key at most `gap` apart. Works on streams with a watermark too."""
    burst = F.session_window("ts", gap)
    return changes.groupBy(*key, burst.alias("burst")).agg(F.max_by(value, "ts").alias(value), F.count("*").alias("merged"), F.max("ts").alias("ts")).select(*key, value, "merged", "ts")


def bursts(changes: DataFrame, gap_ms: int, key: list[str] = ("vault", "path")) -> DataFrame:
    """As debounce, for tables: each burst's last action, first and last time and number of changes (key, action,
    merged, first, last). Of changes at the same time an upsert wins, as the file is then looked at again.

    Changes of a key in one interval of `gap_ms` belong together in any case, so they are combined before any row is
    shuffled, and a key that holds a large share of all changes brings a row for each interval and task. Changes
    without a time are left out.
    """
    key, quiet = list(key), F.make_dt_interval(secs=F.lit(gap_ms / 1000))
    last = F.max(F.struct("ts", "action")).alias("end")
    near = changes.groupBy(*key, F.window("ts", f"{gap_ms} milliseconds").alias("near")).agg(F.min("ts").alias("first"), last, F.count("*").alias("merged"))
    line = Window.partitionBy(*key).orderBy("first")
    starts = F.coalesce(F.col("first") - F.lag("end.ts").over(line) > quiet, F.lit(True))
    joined = near.withColumn("starts", starts).withColumn("burst", F.sum(F.col("starts").cast("long")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return joined.groupBy(*key, "burst").agg(F.max("end").alias("end"), F.sum("merged").alias("merged"), F.min("first").alias("first")).select(*key, "end.action", "merged", "first", F.col("end.ts").alias("last"))


def fold(changes: DataFrame, key: list[str] = ("vault", "path"), value: str = "action", order: list[str] = ("ts",)) -> DataFrame:
    """The last value of each key, and how many changes it had."""
    return changes.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias(value), F.count("*").alias("changes"))


def events(diff: DataFrame, detected_at) -> DataFrame:
    """A change event for each file that was created, modified or deleted; deletions carry the hash that was."""
    kind = F.create_map(*[F.lit(x) for kv in EVENTS.items() for x in kv])[F.col("effect")]
    known = diff.withColumn("event_type", kind).where(F.col("event_type").isNotNull())
    digest = F.when(F.col("effect") == "deleted", F.col("previous_hash")).otherwise(F.col("content_hash"))
    return known.select(F.lit("file_changed").alias("type"), "event_type", "vault", "path", digest.alias("content_hash"), detected_at.alias("detected_at"))


def as_lines(found: DataFrame) -> DataFrame:
    return found.select(F.to_json(F.struct(*found.columns)).alias("value"))


def apply_batch(changes: DataFrame, files: DataFrame, disk: DataFrame) -> DataFrame:
    """The diff of one micro-batch: upserts against the disk (missing there means deleted), removals against the index."""
    last = fold(changes).drop("changes")
    own = files.join(last, ["vault", "path"], "left_semi")
    here = disk.join(last.where(F.col("action") == "upsert"), ["vault", "path"], "left_semi")
    return scan_diff(here, own)


def watch(stream: DataFrame, index: Callable[[DataFrame, int], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Runs a stream of changes: `index` writes the snapshot of a batch and gives its diff, then `sink` gets the events."""

    def batch(df: DataFrame, n: int) -> None:
        sink(events(index(df, n), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")), n)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def lagged(vault: str | None, oldest_kept: int, wanted: int) -> dict | None:
    """The control event for a reader that wants batches which are no longer kept."""
    return {"type": "stream_lagged", "vault": vault, "missed": oldest_kept - wanted, "action": "resync_required"} if wanted < oldest_kept else None
