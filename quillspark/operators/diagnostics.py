"""Diagnostics: chunk summaries and differences, warnings, status of vaults, health."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.errors import EngineError
from quillspark.functions.chunker import HARD, diagnose


def chunk_diff(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """vault, file_path, chunk_index, change: changed, added, removed or same, place by place."""
    cols = ["vault", "file_path", "chunk_index", "content_hash", "start_byte", "end_byte"]
    a, b = stored.select(*cols).alias("a"), recomputed.select(*cols).alias("b")
    keys = cols[:3]
    j = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full_outer")
    same = (F.col("a.content_hash") == F.col("b.content_hash")) & (F.col("a.start_byte") == F.col("b.start_byte")) & (F.col("a.end_byte") == F.col("b.end_byte"))
    change = F.when(F.col("a.vault").isNull(), "added").when(F.col("b.vault").isNull(), "removed").when(same, "same").otherwise("changed")
    return j.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], change.alias("change"))


def annotate(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Stored chunks with the boundaries that a new run gives them; indexed_unknown where place or hash differ."""
    new = recomputed.select("vault", "file_path", "chunk_index", "content_hash", "started_by", "ended_by")
    j = stored.drop("started_by", "ended_by").join(new, ["vault", "file_path", "chunk_index", "content_hash"], "left")
    return j.fillna("indexed_unknown", ["started_by", "ended_by"])


def chunk_summary(chunks: DataFrame) -> DataFrame:
    """vault, file_path and the number and size of chunks; a size over the hard limit counts as oversized."""
    size = F.col("end_byte") - F.col("start_byte")
    return chunks.groupBy("vault", "file_path").agg(F.count("*").alias("chunks"), F.min(size).alias("min_bytes"), F.max(size).alias("max_bytes"), F.avg(size).alias("avg_bytes"), F.count_if(size > HARD).alias("oversized"))


def diagnosed(chunks: DataFrame) -> DataFrame:
    """chunks with fenced_bytes, languages, thematic_breaks, code_heavy, and warnings in words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            found = [diagnose(c or "") for c in x["content"]]
            yield x.assign(**{k: [f[k] for f in found] for k in ("fenced_bytes", "languages", "thematic_breaks", "code_heavy")})

    fields = "fenced_bytes long, languages array<string>, thematic_breaks int, code_heavy boolean"
    d = chunks.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in chunks.dtypes) + ", " + fields)
    return d.withColumn("warnings", F.array_compact(F.array(F.when(F.col("code_heavy"), "code-heavy"), F.when(F.col("thematic_breaks") > 0, "thematic-break-present"))))


def debug_summary(found: DataFrame) -> DataFrame:
    """chunk_summary for chunks that were diagnosed and have boundaries, with the code-heavy ones and the breaks."""
    at_break = F.count_if(F.col("ended_by") == "thematic_break") + F.count_if((F.col("chunk_index") == 0) & (F.col("started_by") == "thematic_break"))
    more = found.groupBy("vault", "file_path").agg(F.count_if("code_heavy").alias("code_heavy"), at_break.alias("break_boundaries"))
    return chunk_summary(found).join(more, ["vault", "file_path"])


def owner(files: DataFrame, path: str) -> str:
    """The one vault that has a path."""
    found = [r[0] for r in files.where(F.col("path") == path).select("vault").distinct().take(2)]
    if len(found) != 1:
        raise EngineError("path_not_found" if not found else "invalid_request", f"{path!r} is in {'no vault' if not found else 'several vaults'}")
    return found[0]


def status(files: DataFrame, vaults: DataFrame | None = None) -> DataFrame:
    """vault, files, last_indexed; with vaults (id), those without files too."""
    s = files.groupBy("vault").agg(F.count("*").alias("files"), F.max("indexed_at").alias("last_indexed"))
    if vaults is None:
        return s
    return vaults.select(F.col("id").alias("vault")).join(s, "vault", "left").select("vault", F.coalesce("files", F.lit(0)).alias("files"), "last_indexed").orderBy("vault")


def health(watcher_alive: bool, store_ok: bool, errored_vaults: int, embedding_ok: bool) -> tuple[str, int]:
    if not watcher_alive or not store_ok:
        return "unhealthy", 503
    return ("degraded" if errored_vaults or not embedding_ok else "healthy"), 200
