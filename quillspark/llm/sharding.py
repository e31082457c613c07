"""Shards of bounded size by extendible hashing. JVM-side only.

Each row has a hash of 60 bits. A bucket is a prefix of it; only buckets over the byte limit split on another bit. The
sizes of all prefixes come from one histogram by the longest prefix looked at, summed before it is shuffled; buckets
that don't fit even there are looked at again by more bits, and nothing else is. The directory (hash prefix -> bucket)
is joined back to the rows by that prefix, so hot keys don't matter: the hash covers id, text and a number for
repeated rows.

Defined results: a row over the limit on its own gets a shard of its own, marked `over`; null ids and texts hash as
such, null texts have 0 bytes; repeated rows are numbered and spread; an empty table gives an empty one. Other columns
are ignored by `assign`, kept by `write_shards`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm._common import cut, sized

BITS = 60
#: Copies of a row that one task numbers at a time.
CHUNK = 4096


def _hash(*parts):
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, BITS // 4), 16, 10).cast("bigint")


def _key():
    return _hash(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(F.coalesce("text", F.lit(""))))


def _own(copy):
    """The hash of a row's nth copy."""
    return F.when(copy == 0, F.col("h")).otherwise(_hash(F.col("h").cast("string"), copy.cast("string"))).alias("hash")


def _bytes():
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, bytes, hash: a row for each row of docs, with a hash of its own."""
    d = docs.select("doc_id", _bytes(), _key().alias("h"))
    d = d.groupBy("doc_id", "bytes", "h").agg(F.count("*").alias("n"))
    few = d.where(F.col("n") <= CHUNK).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    many = d.where(F.col("n") > CHUNK).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {CHUNK}"))))
    many = many.repartition("h", "chunk").withColumn("copy", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("n") - 1, F.col("chunk") * CHUNK + CHUNK - 1)))).drop("chunk")
    return few.unionByName(many).select("doc_id", "bytes", _own(F.col("copy")))


def _prefix(column, bits, of: int = BITS):
    return F.call_function("shiftright", column, F.lit(of).cast("int") - bits)


def assign(docs: DataFrame, limit: int, margin_bits: int = 3) -> DataFrame:
    """doc_id, bytes, shard (the bucket's prefix in binary digits, "" if one holds all), shard_bytes, shard_rows, over."""
    return place(cut(_rows(docs), "shard-rows"), limit, margin_bits)


def place(rows: DataFrame, limit: int, margin_bits: int = 3) -> DataFrame:
    """rows (hash, bytes and others, written) without the hash but with their shards."""
    names = [c for c in rows.columns if c != "hash"]
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    bits, done, rest = min(BITS, max(0, (total // limit).bit_length()) + margin_bits), [], rows
    while True:
        hist = rest.groupBy(_prefix(F.col("hash"), F.lit(bits)).alias("entry")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n"))
        levels = hist.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(bits)))).withColumn("prefix", _prefix(F.col("entry"), F.col("depth"), bits))
        buckets = levels.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        last = bits == BITS
        fits = buckets.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | (F.lit(last) & (F.col("depth") == bits)))
        best = levels.join(fits, ["depth", "prefix"]).groupBy("entry").agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_rows")).alias("x"))
        directory = cut(best.select("entry", "x.*"), "directory")
        entry = _prefix(F.col("hash"), F.lit(bits)).alias("entry")
        keyed = rest.select(*names, "hash", entry)
        put = keyed.join(sized(directory), "entry").withColumn("shard", F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0"))))
        done.append(put.select(*names, "shard", "shard_bytes", "shard_rows", (F.col("shard_bytes") > limit).alias("over")))
        placed = directory.agg(F.coalesce(F.sum(F.lit(1)), F.lit(0))).first()[0]
        if last or placed == hist.count():
            return reduce(DataFrame.unionByName, done)
        rest = cut(keyed.join(sized(directory.select("entry")), "entry", "left_anti").drop("entry"), "oversized")
        bits = min(BITS, bits + 8)


def write_shards(docs: DataFrame, limit: int, path: str) -> str:
    """Writes docs as Parquet with a folder for each shard; the column that names the shard: "shard", or with numbers
    where docs has such columns.

    Rows are numbered in a written table. Copies of a row are counted by the tasks that wrote them, so no task sees all
    copies, and each row goes where `assign` puts a row of its hash and number.
    """
    column = next(c for i in range(len(docs.columns) + 1) if (c := f"shard_{i}" if i else "shard") not in {x.lower() for x in docs.columns})
    own = docs.select(F.struct(*docs.columns).alias("row"), _bytes(), _key().alias("h"), F.monotonically_increasing_id().alias("id"), F.spark_partition_id().alias("task"))
    own = cut(own, "numbered-documents")
    n = own.groupBy("h", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("h").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = n.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    copy = F.col("begin") + F.row_number().over(Window.partitionBy("h", "task").orderBy("id")) - 1
    rows = cut(own.select("id", "bytes", "h", "task").join(starts, ["h", "task"]).select("id", "bytes", "h", copy.alias("copy")).select("id", "bytes", _own(F.col("copy"))), "shard-rows")
    put = own.select("id", "row").join(place(rows, limit).select("id", F.col("shard").alias("to")), "id")
    put.select("row.*", F.concat(F.lit("b"), "to").alias(column)).repartition(column).write.partitionBy(column).parquet(path)
    return column
