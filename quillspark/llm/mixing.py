"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash; a copy of a document has a virtual finish time, the source's words up
to and with it over the source's target. All copies are then ranged by that time and taken up to the total budget; the
one that crosses it is cut. Copies are sorted by ranges whose bounds are quantiles, and running sums are taken over
ranges first (`prefix_sums`), so neither a hot source, nor one whose copies all end late, nor the global order meets in
one task; only ids and sizes are shuffled, texts never. Sources may be many (domains): their order is treated likewise.

Targets: a source may give at most `repeats` times its size; what it can't give is shared among the others by weight.

Defined results: null texts and texts without words have size 0 and are never taken; a null source is a source of its
own, the last; repeated rows (same id, source and size) share what is taken of them, rounded down; a table without
words has targets of 0; an empty one gives an empty one. Other columns are ignored by `mix`, kept by `mixed`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm._common import BROADCAST_ROWS, cut, prefix_sums, sized, words

#: Weights by a source's place among all, in order and over again.
WEIGHTS = (1, 2, 3)
REPEATS = 3


def running(rows: DataFrame, order: list[str], weight: str, out: str, one_task: int = BROADCAST_ROWS) -> DataFrame:
    """Adds the running sum of weight over all rows by order. Few rows (counted) are summed in one task."""
    if rows.limit(one_task + 1).count() <= one_task:
        return rows.withColumn(out, F.sum(weight).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return prefix_sums(rows.withColumn("all", F.lit(0)), ["all"], order, weight, out).drop("all")


def targets(sources: DataFrame, repeats: int = REPEATS, one_task: int = BROADCAST_ROWS) -> DataFrame:
    """source, source_size, target for source, source_size, weight (a row for each source, cheap to read).

    Sources fill up in the order of their capacity over their weight; the common level is that of the first number of
    full ones at which the next still holds its share.
    """
    s = sources.withColumn("none", F.col("source").isNull()).withColumn("ratio", F.expr("case when source_size > 0 then source_size / weight else 0 end"))
    s = s.withColumn("room", repeats * F.col("source_size"))
    order = ["ratio", "none", "source"]
    s = running(running(s, order, "room", "room_upto", one_task), order, "weight", "weight_upto", one_task)
    size, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(size) - (F.col("room_upto") - F.col("room"))) / (F.lit(weight) - F.col("weight_upto") + F.col("weight"))
    holds = F.when(level * F.col("weight") <= F.col("room"), F.struct(*order, level.alias("level")))
    found = s.agg(F.min(holds)["level"]).first()[0]
    return sources.select("source", "source_size", F.least(F.col("weight") * F.lit(found).cast("double"), (repeats * F.col("source_size")).cast("double")).alias("target"))


def weighted(measured: DataFrame, weights: tuple[int, ...] = WEIGHTS, one_task: int = BROADCAST_ROWS) -> DataFrame:
    """source, source_size, weight: sources by code point, null last, with the weights over and over."""
    each = measured.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("none", F.col("source").isNull()).withColumn("one", F.lit(1))
    placed = running(cut(each, "sources"), ["none", "source"], "one", "place", one_task)
    return placed.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")).alias("weight"))


def shuffled(seed: int = 0):
    """A place in [0, 1) for each doc_id."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row of docs (doc_id, source, text)."""
    measured = cut(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size")), "sizes")
    goal = cut(targets(cut(weighted(measured, weights), "weights"), repeats), "targets")
    items = measured.where("size > 0").groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    items = cut(items.withColumn("tokens", F.col("size") * F.col("n")).withColumn("place", shuffled(seed)), "items")
    lined = prefix_sums(items, ["source"], ["place", "doc_id", "size"], "tokens", "upto")
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    copies = lined.alias("a").join(sized(goal).alias("b"), same).select("a.*", "b.source_size", "b.target").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    copies = copies.withColumn("finish", (F.col("copy") * F.col("source_size") + F.col("upto")) / F.col("target"))
    copies = copies.select(F.lit(0).alias("all"), "doc_id", "source", "size", "n", "tokens", "copy", (F.col("finish") / (1 + F.col("finish"))).alias("time"), F.col("place"))
    line = prefix_sums(copies, ["all"], ["time", "place", "doc_id", "size", "source", "copy"], "tokens", "upto")
    budget = goal.agg(F.coalesce(F.round(F.sum("target")), F.lit(0.0)).cast("long")).first()[0]
    plan = line.groupBy("doc_id", "source", "size").agg(F.expr(f"sum(greatest(0, least(tokens, {budget} - upto + tokens))) div max(n)").alias("taken"))
    eq = lambda *k: [F.col(f"m.{x}").eqNullSafe(F.col(f"p.{x}")) for x in k]
    got = measured.alias("m").join(plan.alias("p"), eq("doc_id", "source", "size"), "left").select("m.*", F.coalesce("p.taken", F.lit(0)).cast("long").alias("taken"))
    return got.alias("m").join(sized(goal).alias("p"), eq("source")).select("m.doc_id", "m.source", "m.size", "p.source_size", "p.target", "m.taken")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = 0) -> DataFrame:
    """The mix itself: rows of docs with all their columns, each as often as it is taken (a part counts as a whole)."""
    plan = mix(docs, weights, repeats, seed).where("taken > 0")
    times = plan.select("doc_id", "source", "size", F.ceil(F.col("taken") / F.col("size")).cast("int").alias("times")).distinct()
    own = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))
    same = [F.col(f"o.{x}").eqNullSafe(F.col(f"t.{x}")) for x in ("doc_id", "source", "size")]
    return own.alias("o").join(times.alias("t"), same).select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
