"""Helpers that the training-data operators share: the shared folder, written cuts of the lineage, sized broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that separates words, for Java and Python regular expressions alike.
WS = r"[\x20\x09-\x0D]+"
#: Rows that a side may have to be broadcast; above it the same join is left to a shuffle.
BROADCAST_ROWS = 100_000
#: Bytes that such a side's wide columns may have in all.
BROADCAST_BYTES = 64 << 20
#: Whole texts that go to Python at once.
TEXTS = 500


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a fresh temporary one in local mode only."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def cut(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """df, written to the shared folder and read again: computed once, and safe from lost executors.

    batch: how many rows go to Python at once, where they hold whole texts; the session's own number otherwise.
    """
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    path, own = shared_path(spark, name), spark.conf.get(key)
    spark.conf.set(key, str(batch or own))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, own)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS, wide: Column | None = None) -> DataFrame:
    """df (cheap to count), marked for broadcast if it has at most so many rows, else as it is.

    wide: the bytes of a row's texts or arrays, which then may be at most BROADCAST_BYTES in all.
    """
    n, size = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(F.lit(0) if wide is None else wide), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and size <= BROADCAST_BYTES else df


def join_hot(rows: DataFrame, side: DataFrame, keys: list[str], n: str) -> DataFrame:
    """rows joined by keys (never null) with side, which has each key once and in `n` how many rows have it.

    Keys with more rows than a task should have are at most as many as there are tasks; they are broadcast, so that the
    rows of a hot key stay where they are. The others meet by a shuffle. Both tables are read twice.
    """
    total = side.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    each = max(1000, total // partitions(rows.sparkSession))
    hot, rest = (F.broadcast(side.where(F.col(n) > each)), side.where(F.col(n) <= each))
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(rest, keys))


def join_dealt(rows: DataFrame, side: DataFrame, keys: list[str], n: str, spread: list[str], how: str = "inner") -> DataFrame:
    """As join_hot, for wide sides: the rows of a hot key are dealt out by `spread` over as many parts as they call for,
    and the side's row goes to each; only the hot keys and their numbers of parts are broadcast."""
    total = side.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    each = max(1000, total // partitions(rows.sparkSession))
    last = F.expr(f"cast((`{n}` - 1) div {each} as int)")
    hot = F.broadcast(side.where(F.col(n) > each).select(*keys, last.alias("last part")))
    part = F.pmod(F.xxhash64(*spread), F.coalesce(F.col("last part"), F.lit(0)) + 1).cast("int")
    dealt = rows.join(hot, keys, "left").withColumn("part", part).drop("last part")
    return dealt.join(side.withColumn("part", F.explode(F.sequence(F.lit(0), last))), [*keys, "part"], how).drop("part")


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS), "")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def prefix_sums(rows: DataFrame, keys: list[str], order: list[str], weight: str, out: str, place: str | None = None) -> DataFrame:
    """Adds `out`: the running sum of `weight` in each group of `keys`, by the columns `order`.

    No group meets in one task: rows are sorted by range (bounds are quantiles of a sample, taken by Spark) or, where
    `place` is given (a number spread evenly over [0, 1) in each group, the first of `order`), dealt by it into as many
    ranges as a group's share of all rows calls for. Sums of ranges are added up first, then the rows inside each
    range. Rows that agree in `order` get their sums in any order; there should be few of the same.
    """
    spark, at, begin = rows.sparkSession, f"{out} range", f"{out} start"
    if place is None:
        put = cut(rows.repartitionByRange(partitions(spark), *keys, *order).withColumn(at, F.spark_partition_id()), "ranges")
    else:
        width = max(32, rows.count() // (6 * partitions(spark)) + 1)
        shares = sized(rows.groupBy(*keys).agg((F.expr(f"count(*) div {width}") + 1).alias(at)))
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
        put = rows.alias("a").join(shares.alias("b"), same).select("a.*", F.floor(F.col(place) * F.col(f"`{at}`")).alias(at))
    before = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = put.groupBy(*keys, at).agg(F.sum(weight).alias(begin)).withColumn(begin, F.coalesce(F.sum(begin).over(before), F.lit(0)))
    same = [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in [*keys, at]]
    put = put.alias("a").join(sized(cut(starts, "starts")).alias("b"), same).select("a.*", begin)
    inside = Window.partitionBy(*keys, at).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return put.withColumn(out, F.col(begin) + F.sum(weight).over(inside)).drop(at, begin)
