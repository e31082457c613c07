"""Semantic search: exact nearest neighbours by cosine, as passages or grouped into documents.

The k nearest of each vault are found first; prefix and least similarity only filter those afterwards. Dot products
are a fold over each row's array inside the JVM; per-vault top-k is pruned in each task before its shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.errors import EngineError
from quillspark.functions.text import byte_truncate, has_prefix
from quillspark.operators.merge import Result, check_limit, per_vault

BUILDING = "semantic index is building"


def cosine_distance(vector: Column, query: list[float]) -> Column:
    """1 - cos; null where it has no meaning (no vector, no direction, another length)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    norm = math.sqrt(sum(float(x) ** 2 for x in query))
    sums = F.aggregate(F.zip_with(vector, q, lambda x, y: F.struct((x.cast("double") * y).alias("d"), (x.cast("double") * x.cast("double")).alias("s"))), F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("s")), lambda a, x: F.struct((a["d"] + x["d"]).alias("d"), (a["s"] + x["s"]).alias("s")))
    fits = (F.size(vector) == len(query)) & (sums["s"] > 0) & F.lit(norm > 0)
    return F.when(fits, 1 - sums["d"] / (F.sqrt(sums["s"]) * F.lit(norm or 1.0)))


def nearest(chunks: DataFrame, query: list[float], k: int, prefix: str | None = None, min_similarity: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The k nearest chunks of each vault with distance and score, filtered afterwards; and a row if a vault's k were used up."""
    d = chunks.withColumn("distance", cosine_distance(F.col("embedding"), query)).where(F.col("distance").isNotNull()).drop("embedding")
    best = per_vault(d, [F.col("distance"), F.col("file_path"), F.col("chunk_index")], k)
    if (c := has_prefix(F.col("file_path"), prefix)) is not None:
        best = best.where(c)
    full = best.groupBy("vault").count().where(F.col("count") >= k)
    best = best.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("distance") / 2)))
    if min_similarity is not None:
        best = best.where(F.col("score") >= min(1.0, max(0.0, min_similarity)))
    return best, full


def payload(content: Column, include: str = "preview", preview_bytes: int = 600) -> list[Column]:
    """text, text_kind, text_truncated for a passage: none, preview or full."""
    if include not in ("none", "preview", "full"):
        raise EngineError("invalid_request", f"unknown text payload {include!r}")
    if include == "none":
        return []
    check_limit(preview_bytes, 2000, "preview_bytes")
    text = content if include == "full" else byte_truncate(content, preview_bytes)
    return [text.alias("text"), F.lit(include).alias("text_kind"), (F.lit(False) if include == "full" else F.octet_length(content) > preview_bytes).alias("text_truncated")]


def _cut(full: DataFrame, rows: DataFrame, limit: int) -> DataFrame:
    """A row if a vault's k were used up, or if there are more rows than the limit."""
    more = rows.limit(limit + 1).groupBy().count().where(F.col("count") > limit)
    return full.select("count").unionByName(more)


def headings(c: Column) -> Column:
    return F.when(c == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(c, "/"))


def search_chunks(chunks: DataFrame, query: list[float], prefix: str | None = None, min_similarity: float | None = None, limit: int = 10, include: str = "preview", preview_bytes: int = 600) -> Result:
    best, full = nearest(chunks, query, check_limit(limit), prefix, min_similarity)
    order = [F.desc("score"), F.col("vault"), F.col("file_path"), F.col("chunk_index")]
    keep = [c for c in ("chunk_hash", "file_hash", "vault_name") if c in chunks.columns]
    rows = best.select("score", F.col("file_path"), "chunk_index", headings(F.col("heading_path")).alias("heading_path"), *payload(F.col("content"), include, preview_bytes), "vault", *keep)
    return Result(rows.orderBy(*order).limit(limit), _cut(full, rows, limit))


def search_documents(chunks: DataFrame, query: list[float], prefix: str | None = None, min_similarity: float | None = None, limit: int = 10, chunks_per_document: int = 3, multiplier: int = 10, cap: int = 1000, include: str = "preview", preview_bytes: int = 600) -> Result:
    """Documents by their best chunk, each with its best chunks as evidence; grouped by vault, path and the file's hash."""
    check_limit(limit)
    check_limit(chunks_per_document, 100, "chunks_per_document")
    best, full = nearest(chunks, query, max(1, min(limit * multiplier, cap)), prefix, min_similarity)
    shown = F.struct((-F.col("score")).alias("order"), "chunk_index", "score", headings(F.col("heading_path")).alias("heading_path"), *payload(F.col("content"), include, preview_bytes))
    docs = best.groupBy("vault", "file_path", "file_hash").agg(F.max("score").alias("score"), F.slice(F.array_sort(F.collect_list(shown)), 1, chunks_per_document).alias("chunks"))
    docs = docs.withColumn("chunks", F.transform("chunks", lambda x: x.dropFields("order")))
    return Result(docs.orderBy(F.desc("score"), "vault", "file_path").limit(limit), _cut(full, docs, limit))


def building_hint(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """vault, building: vaults with files but no vector yet."""
    have = chunks.where(F.col("embedding").isNotNull()).select("vault").distinct().withColumn("has", F.lit(True))
    return files.select("vault").distinct().join(have, "vault", "left").select("vault", F.col("has").isNull().alias("building"))
