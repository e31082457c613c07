"""The incremental scan: what is on disk against what is indexed, as a full outer join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EFFECTS = ("inserted", "updated", "hash_unchanged", "skipped", "deleted")


def content_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content.cast("binary"), 256))


def same_stat(disk: str, files: str) -> Column:
    """Whether size and time say that a file is as indexed; an empty hash asks for a new index entry in any case."""
    return (F.col(f"{disk}.size") == F.col(f"{files}.size")) & (F.col(f"{disk}.mtime") == F.col(f"{files}.mtime")) & (F.col(f"{files}.content_hash") != "")


def stat_candidates(disk: DataFrame, files: DataFrame) -> DataFrame:
    """vault, path of files that must be read: new ones, those whose size or time differ, and those without a hash."""
    j = disk.alias("d").join(files.select("vault", "path", "size", "mtime", "content_hash").alias("f"), ["vault", "path"], "left")
    return j.where(~F.coalesce(same_stat("d", "f"), F.lit(False))).select("vault", "path")


def scan_diff(disk: DataFrame, files: DataFrame) -> DataFrame:
    """vault, path, effect, content_hash, previous_hash for disk and files (vault, path, size, mtime, content_hash).

    Size and time decide first, the hash after that; an empty hash asks for a new index entry in any case.
    """
    d, f = (t.select("vault", "path", "size", "mtime", "content_hash").alias(n) for t, n in ((disk, "d"), (files, "f")))
    j = d.join(f, (F.col("d.vault") == F.col("f.vault")) & (F.col("d.path") == F.col("f.path")), "full_outer")
    known = F.col("f.content_hash") != ""
    effect = (
        F.when(F.col("f.path").isNull(), "inserted")
        .when(F.col("d.path").isNull(), "deleted")
        .when(known & (F.col("d.size") == F.col("f.size")) & (F.col("d.mtime") == F.col("f.mtime")), "skipped")
        .when(known & (F.col("d.content_hash") == F.col("f.content_hash")), "hash_unchanged")
        .otherwise("updated")
    )
    return j.select(F.coalesce("d.vault", "f.vault").alias("vault"), F.coalesce("d.path", "f.path").alias("path"), effect.alias("effect"), F.col("d.content_hash").alias("content_hash"), F.col("f.content_hash").alias("previous_hash"))


def report(diff: DataFrame) -> DataFrame:
    """vault and the number of files of each effect."""
    return diff.groupBy("vault").agg(*[F.count_if(F.col("effect") == e).alias(e) for e in EFFECTS])


def apply_diff(files: DataFrame, disk: DataFrame, diff: DataFrame, now: str) -> DataFrame:
    """The files table after the scan: gone files left out, changed rows replaced, others as they were."""
    change = diff.select("vault", "path", "effect")
    cols = files.columns
    old = files.join(change.where(F.col("effect").isin("deleted", "updated", "hash_unchanged")), ["vault", "path"], "left_anti")
    new = disk.join(change.where(F.col("effect").isin("inserted", "updated", "hash_unchanged")), ["vault", "path"]).withColumn("indexed_at", F.lit(now))
    return old.select(*cols).unionByName(new.select(*cols))


def rewrite_chunks(chunks: DataFrame, new_chunks: DataFrame, diff: DataFrame) -> DataFrame:
    """The chunks table after the scan: those of gone and changed files are dropped, new ones added."""
    gone = diff.where(F.col("effect").isin("deleted", "updated", "inserted")).select("vault", F.col("path").alias("file_path"))
    return chunks.join(gone, ["vault", "file_path"], "left_anti").unionByName(new_chunks, allowMissingColumns=True)


def rebuild(files: DataFrame) -> DataFrame:
    """The files table that makes the next scan index everything anew."""
    return files.withColumn("content_hash", F.lit(""))
