"""The given tables as tables of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.diff import content_hash

INDEXED_AT = "2026-01-01T00:00:00.000000Z"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as notes: a language is a vault, a source a folder."""
    path = F.concat(F.lit("notes/"), "source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".md"))
    return table(spark, sf_dir, "documents").select(
        F.col("lang").alias("vault"), path.alias("path"), F.octet_length("text").cast("long").alias("size"), F.lit(INDEXED_AT).alias("mtime"),
        content_hash(F.col("text")).alias("content_hash"), F.lit(INDEXED_AT).alias("indexed_at"), F.col("text").alias("content"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as chunks: a conversation is a file, a turn a chunk."""
    return table(spark, sf_dir, "conversations").select(
        F.lit("talk").alias("vault"), F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("file_path"), F.col("turn").cast("int").alias("chunk_index"),
        F.col("role").alias("heading_path"), F.col("text").alias("content"), F.lit(0).cast("long").alias("start_byte"), F.octet_length("text").cast("long").alias("end_byte"), content_hash(F.col("text")).alias("content_hash"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as chunks with vectors: a label is a file, ids modulo 3 are vaults."""
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("v"), (F.col("vec_id") % 3).cast("string")).alias("vault"), F.concat(F.lit("topic/"), F.col("label").cast("string"), F.lit(".md")).alias("file_path"), F.col("vec_id").cast("int").alias("chunk_index"),
        F.lit("").alias("heading_path"), F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("content"), F.concat(F.lit("h"), F.col("label").cast("string")).alias("file_hash"), "embedding",
    )


#: What an event of the given table does to a note; other events are mere accesses.
KINDS = {"signup": "create", "click": "modify", "purchase": "modify", "error": "remove"}


def notifications(events: DataFrame) -> DataFrame:
    """events as raw notifications: a user's number makes the vault and the note. Works on streams too."""
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("event_type")], F.lit("access"))
    path = F.concat(F.lit("notes/user-"), F.col("user_id").cast("string"), F.lit(".md"))
    return events.select(F.concat(F.lit("v"), F.pmod("user_id", F.lit(4)).cast("string")).alias("vault"), kind.alias("kind"), F.lit(None).cast("string").alias("rename_mode"), F.array(path).alias("paths"), "ts")
