"""Exact top-k search by inner product with vector-approximation files.

Each dimension's range over all vectors (one pass, 2 numbers a dimension) is cut into cells of equal width. The
approximation file holds two bytes a component; exact vectors lie in a table of their own. Queries are dealt into lots,
the file into parts, and each lot scans each part in a task of its own: the lot is held there, the part streams by.
The inner product with the cells' middles, give or take a margin, bounds the exact one. From a part leave only those
whose upper bound reaches the kth lower bound there, then only those that reach the kth of all. Exact vectors are then
read by id in the order of their upper bounds, a round at a time, until the next bound of a query lies below its kth
exact score.

A task holds LOT_BYTES of queries and HELD bounds, however large the table is. The file is shuffled once for each lot,
queries once for each part; both numbers follow from the number of cores until lots are full. A cell is two bytes, as
by one byte all near copies of a query are within its margin, and a group of them leaves as many bounds as it has pairs.

Of equal vectors no more than those of the k + 1 least different ids are needed (one may be the query's own), and of
these k rows each; so more are left out beforehand, exactly, and a hot vector is no hot part. Vectors whose hash is
not that frequent stay where they are.

Components are whole numbers held as doubles. Products that surely fit in a long are taken as longs; others as
unbounded integers, and only a result that doesn't fit in the column raises an error, as does a component beyond a
double once it's scaled.

Defined results: vectors that are null or hold a null or non-finite component take no part, nor do null ids; vectors
are compared with those of their own length, of length 0 too (score 0); a repeated id is a row like any other, but
never its own query's result, and its different vectors are queries of their own, whose results are ranked together; an
empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm._common import cut, partitions, sized

CELLS, CELL = 1 << 16, np.uint16
#: Bytes of a lot's queries, queries that call for another lot, and vectors that call for another part.
LOT_BYTES, QUERIES, PART = 32 << 20, 1024, 1024
#: Estimates made at a time, bounds held at a time, vectors that are looked through first, and bytes of vectors that go to Python at once.
AT_ONCE, HELD, FIRST, BATCH_BYTES = 1 << 20, 1 << 21, 512, 8 << 20


def integers(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component, as doubles; rows that take no part are left out."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    fits = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", finite)
    # adding up halves to a whole number below 2 ** 52, floor() is exact; larger doubles are whole numbers
    whole = lambda y: F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)
    return vectors.where(fits).select("vec_id", F.transform("embedding", lambda x: whole(F.lit(float(scale)) * x.cast("double"))).alias("v"))


class Cells:
    """The cells of each dimension: where they begin and how wide they are."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low, self.width = low, np.floor((high - low) / CELLS) + 1
        self.most = np.maximum(np.abs(low), np.abs(high))
        #: Of the estimates.
        self.kind = np.float32 if float(self.most @ self.most) < 1e30 else np.float64

    def of(self, v: np.ndarray) -> np.ndarray:
        return np.clip((v - self.low) // self.width, 0, CELLS - 1).astype(CELL)

    def middle(self, cells: np.ndarray) -> np.ndarray:
        return (self.low + cells * self.width + (self.width - 1) / 2).astype(self.kind)

    def off(self, queries: np.ndarray) -> np.ndarray:
        """How far each query's estimates, the inner products with the middles, may be from the exact ones."""
        eps, largest = float(np.finfo(self.kind).eps), np.abs(queries) @ (self.most + self.width)
        # terms are halves of whole numbers: up to 1 / eps nothing is rounded
        rounding = np.where(largest < 1 / eps, 0, (1e-9 + (len(self.low) + 4) * eps) * largest)
        return np.abs(queries) @ ((self.width - 1) / 2) + rounding + 1e-6


def scan(cells: Cells, ids: np.ndarray, rows: np.ndarray, block: np.ndarray, query_ids: np.ndarray, query_rows: np.ndarray, queries: np.ndarray, k: int, best: np.ndarray | None = None) -> Iterator[tuple]:
    """query row, row, lower and upper bound of a block's vectors that may be among a query's k best.

    best: each query's k best estimates of the blocks before, the least first; they are brought up to date.
    """
    best = np.full((len(queries), k), -np.inf) if best is None else best
    middle, off, asked = cells.middle(block).T, cells.off(queries), queries.astype(cells.kind)
    step = max(1, AT_ONCE // max(1, len(ids)))
    for at in range(0, len(queries), step):
        estimates, top, d = asked[at : at + step] @ middle, best[at : at + step], off[at : at + step]
        least = np.nextafter((top[:, 0] - 2 * d).astype(cells.kind), cells.kind(-np.inf))
        q, x = np.divmod(np.flatnonzero(estimates >= least[:, None]), max(1, len(ids)))
        other = ids[x] != query_ids[at + q]
        q, x = q[other], x[other]
        e = estimates[q, x].astype(float)
        ends = np.searchsorted(q, np.arange(len(d) + 1))
        for i in np.unique(q[e > top[q, 0]]):
            both = np.concatenate([top[i], e[ends[i] : ends[i + 1]]])
            top[i] = np.partition(both, len(both) - k)[len(both) - k :]
        keep = e >= top[q, 0] - 2 * d[q]
        q, x, e = q[keep], x[keep], e[keep]
        out, ends = (query_rows[at + q], rows[x], e - d[q], e + d[q]), np.searchsorted(q, np.arange(len(d) + 1))
        for i in range(len(d)):
            yield tuple(c[ends[i] : ends[i + 1]] for c in out)


class _Lot:
    """A lot's queries, and the bounds of those vectors of a part's blocks so far that may be among a query's k best."""

    def __init__(self, cells: Cells, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, k: int):
        self.cells, self.ids, self.rows, self.queries, self.k = cells, ids, rows, queries, k
        self.best, self.off = np.full((len(ids), k), -np.inf), cells.off(queries)
        self.found: list[tuple] = []
        self.n = 0

    def look(self, ids: np.ndarray, rows: np.ndarray, block: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Looks through a block; bounds come out only if there are too many to hold, also after those before are thinned."""
        few = FIRST if self.best[0, 0] == -np.inf else 0  # the first vectors tell which of the others are worth a look
        for i, j in ((0, few), (few, len(ids))):
            for got in scan(self.cells, ids[i:j], rows[i:j], block[i:j], self.ids, np.arange(len(self.ids)), self.queries, self.k, self.best):
                if len(got[0]):
                    self.found.append(got)
                    self.n += len(got[0])
                if self.n > HELD:
                    self._thin()
                    if self.n > HELD // 2:
                        yield from self.rest()

    def _thin(self) -> None:
        q, row, low, high = (np.concatenate(c) for c in zip(*self.found, strict=True))
        keep = high >= (self.best[:, 0] - self.off)[q]
        self.found, self.n = [(q[keep], row[keep], low[keep], high[keep])], int(keep.sum())

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.found:
            self._thin()
            q, row, low, high = self.found[0]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (self.rows[q], row, low, high)], names=["query_row", "row", "low", "high"])
        self.found, self.n = [], 0


def _pack(cells: Cells | None):
    """Rows of (vec_id, row, v) with v as bytes: its cells, or the doubles themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.array(b.column(2).flatten(), float).reshape(b.num_rows, -1)
            held = np.ascontiguousarray(v if cells is None else cells.of(v))
            ends = np.arange(b.num_rows + 1, dtype=np.int32) * np.int32(held[:1].nbytes)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(held)])], names=["vec_id", "row", "held"])

    return run


def _look(cells: Cells, dims: int, k: int):
    """Rows of (task, vector, vec_id, row, held), sorted by the first two: each lot, then the part that it scans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, asked, lot = None, [], None
        for b in batches:
            tasks, kinds, ids, rows = (np.array(b.column(i)) for i in range(4))
            ends = np.flatnonzero((np.diff(tasks) != 0) | (np.diff(kinds) != 0)) + 1
            for i, j in zip([0, *ends], [*ends, len(tasks)], strict=True):
                held = np.frombuffer(b"".join(b.column(4).slice(i, j - i).to_pylist()), CELL if kinds[i] else float).reshape(-1, dims)
                if tasks[i] != task:
                    if lot:
                        yield from lot.rest()
                    task, asked, lot = tasks[i], [], None
                if not kinds[i]:
                    asked.append((ids[i:j], rows[i:j], held))
                elif asked or lot:
                    if lot is None:
                        lot, asked = _Lot(cells, *(np.concatenate(c) for c in zip(*asked, strict=True)), k), []
                    yield from lot.look(ids[i:j], rows[i:j], held)
        if lot:
            yield from lot.rest()

    return run


def _score(fits: bool):
    """Rows of (query row, row, upper, query id, id, query vector, vector) with exact scores, as decimal strings if
    they may not fit in a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = (np.array(b.column(i).flatten()).reshape(b.num_rows, -1) for i in (5, 6))
            if fits:
                score = pa.array((a.astype(np.int64) * c.astype(np.int64)).sum(1), pa.int64())
            else:
                whole = [sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for p, q in zip(a, c, strict=True)]
                score = pa.array([str(x) for x in whole]).cast(pa.decimal256(76, 0)).cast(pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), b.column(4), score], names=["query_row", "row", "query_id", "vec_id", "score"])

    return run


def _few_of_equal(v: DataFrame, k: int) -> DataFrame:
    """v without those of equal vectors that are never needed: all but k rows of each id, and all but k + 1 ids."""
    hashed = v.withColumn("hash", F.xxhash64("v"))
    often = sized(cut(hashed.groupBy("hash").count().where(F.col("count") > k).select("hash"), "frequent"))
    hot = hashed.join(often, "hash", "left_semi")
    repeated = hot.withColumn("n", F.row_number().over(Window.partitionBy("hash", "v", "vec_id").orderBy("vec_id"))).where(F.col("n") <= k)
    few = repeated.withColumn("n", F.dense_rank().over(Window.partitionBy("hash", "v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    return hashed.join(often, "hash", "left_anti").select("vec_id", "v").union(few.select("vec_id", "v"))


def _of_one_length(v: DataFrame, dims: int, queries_every: int, k: int) -> DataFrame:
    """query_id, vec_id, score: at least each query's k best, for vectors of one length."""
    spark = v.sparkSession
    ends = v.agg(*[f(F.get("v", F.lit(i))) for i in range(dims) for f in (F.min, F.max)]).first()
    cells = Cells(np.array(ends[::2], float), np.array(ends[1::2], float))
    if not np.isfinite(cells.most).all():
        raise OverflowError("a component is beyond a double once it is scaled")
    fits = float(cells.most @ cells.most) < 2.0**62
    held = cut(_few_of_equal(v, k).withColumn("row", F.monotonically_increasing_id()), "exact-vectors")
    asked = cut(v.where(F.col("vec_id") % queries_every == 0).distinct().withColumn("row", F.monotonically_increasing_id()), "queries")
    n, m, tasks = held.count(), asked.count(), min(partitions(spark), max(32, 4 * spark.sparkContext.defaultParallelism))
    lots = max(1, -(-m // max(1, LOT_BYTES // (8 * dims))), min(round((tasks / 10) ** 0.5), -(-m // QUERIES)))
    parts = max(1, min(-(-tasks // lots), -(-n // PART)))
    batch = max(1, min(10_000, BATCH_BYTES // (8 * dims)))
    pack = lambda d, cells: d.select("vec_id", "row", "v").mapInArrow(_pack(cells), "vec_id long, row long, held binary")
    deal = lambda d, own, others, task, kind: d.withColumn("own", F.pmod(F.xxhash64("row", F.lit(own)), F.lit(own)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).select(task.cast("int").alias("task"), F.lit(kind).alias("vector"), "vec_id", "row", "held")
    index = cut(pack(held, cells), "va-file", batch)
    lot_first, part_first = F.col("own") * parts + F.col("other"), F.col("other") * parts + F.col("own")
    pairs = deal(cut(pack(asked, None), "asked", batch), lots, parts, lot_first, 0).union(deal(index, parts, lots, part_first, 1))
    dealt = pairs.repartitionById(lots * parts, F.col("task")).sortWithinPartitions("task", "vector")
    found = cut(dealt.mapInArrow(_look(cells, dims, k), "query_row long, row long, low double, high double"), "bounds", batch)
    best = Window.partitionBy("query_row")
    kth = found.withColumn("n", F.row_number().over(best.orderBy(F.desc("low")))).where(F.col("n") <= k).groupBy("query_row").agg(F.when(F.max("n") == k, F.min("low")).alias("kth"))
    left = found.join(kth, "query_row").where(F.col("kth").isNull() | (F.col("high") >= F.col("kth"))).drop("kth", "low")
    left = cut(left.withColumn("n", F.row_number().over(best.orderBy(F.desc("high"), "row"))), "survivors")
    most, survivors = left.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    done, upto, size = None, 0, 2 * k if survivors > 8 * k * m else max(1, most)  # few are read at once
    while upto < most:
        now = left.where((F.col("n") > upto) & (F.col("n") <= upto + size))
        if done is not None:  # queries whose next bound is below their kth score are certain
            ranked = done.withColumn("n", F.row_number().over(best.orderBy(F.desc("score")))).where(F.col("n") <= k)
            kth = ranked.groupBy("query_row").agg(F.when(F.max("n") == k, F.min("score")).cast("double").alias("kth"))
            now = now.join(kth, "query_row", "left").where(F.col("kth").isNull() | (F.col("high") * (1 + F.signum("high") * 1e-9) + 1e-6 >= F.col("kth"))).drop("kth")
        read = now.join(held.select("row", "vec_id", "v"), "row").join(asked.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_row")
        exact = read.select("query_row", "row", "high", "query_id", "vec_id", "q", "v").mapInArrow(_score(fits), f"query_row long, row long, query_id long, vec_id long, score {'long' if fits else 'decimal(38,0)'}")
        done = cut(exact if done is None else done.union(exact), "scores", batch)
        upto, size = upto + size, 4 * size
    out = done if done is not None else spark.createDataFrame([], "query_id long, vec_id long, score long")
    return out.select("query_id", "vec_id", F.col("score").cast("decimal(38,0)").alias("score"))


def top_k(vectors: DataFrame, queries_every: int = 100, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score for the queries: the rows of vectors whose id is divisible by queries_every."""
    spark = vectors.sparkSession
    v = cut(integers(vectors, scale), "integers")
    lengths = [r[0] for r in v.groupBy(F.size("v").alias("d")).agg(F.count("*")).collect()]  # a number for each length
    parts = [_of_one_length(v.where(F.size("v") == d).withColumn("v", F.col("v") if d else F.array(F.lit(0.0))), max(1, d), queries_every, k) for d in sorted(lengths)]
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = reduce(DataFrame.union, parts).withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
    long = F.when(F.abs("score") < F.lit(str(2**63)).cast("decimal(38,0)"), F.col("score").cast("long")).otherwise(F.raise_error(F.lit("a score does not fit in a long")).cast("long"))
    return best.select("query_id", "rank", "vec_id", long.alias("score"))
