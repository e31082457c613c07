"""A corpus, from documents to packed sequences: quality rules, near-dedup, secret scans, mixing, packing.

Defined results of all stages, as their operators have them: a null text counts as empty (and a document without ten
words goes at the first stage); a null language or source is one of its own; rows with a null id are documents like
others, each by its text; repeated rows are copies, of which near_dedup leaves one; an empty table gives an empty one;
other columns, whatever they are called, are kept by all stages but the last, which ignores them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import mixing, packing, quality, secrets, simhash
from quillspark.llm._common import cut
from quillspark.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the adaptive rules keep, with all their columns."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least id: five-word shingles, similarity 0.8."""
    return simhash.one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in the place of secrets, and n_chars counted anew where that changed it."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it's taken; those without words aren't."""
    return mixing.mixed(docs)


def packing_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences; an empty document is its end mark alone."""
    return packing.pack(docs, vocabulary())


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("secret_scans", secret_scans), ("source_mix", source_mix), ("best_fit_packing", packing_)]

#: SQL can express neither fingerprints of XXH64 nor the forest nor the tokenizer; tests/llm holds their operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each other stage is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
