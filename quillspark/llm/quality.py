"""Quality rules with adaptive thresholds, from mergeable quantile sketches per language and source. JVM-side only.

A sketch holds counts of values in buckets that are exact below 1,024 and have a relative width of at most 1/512
above; two sketches merge by adding counts, so partial ones are combined before any row is shuffled, and results don't
depend on the order. Sketches of a source in a language that has fewer than `min_group` documents give way to the
language's, and those to that of all documents.

A document is rejected if one of its measures lies beyond its group's fence: the upper quartile plus `spread` times
the distance of the quartiles, or plus the least width in MEASURES where quartiles lie close together (likewise below
the lower quartile for word length). Where a measure is 0 in most documents of a group, as symbols and repeats are in
prose, its quartiles coincide and the least width decides; groups that have more of it get fences of their own.

Defined results: a null text counts as empty; a null language or source is a group of its own; repeated rows each
count and each get a row; an empty table gives an empty one; other columns are ignored by `measure` and kept by
`keep_good`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm._common import WS, cut, sized, words

#: measure -> (SQL over the counts, least width of the fence, is there a lower fence)
MEASURES = {
    "symbols": ("1000 * n_symbols div greatest(word_chars, 1)", 40, False),
    "dup_lines": ("1000 * n_dup_lines div greatest(n_lines, 1)", 300, False),
    "repeats": ("1000 * n_repeat_words div greatest(n_words, 1)", 200, False),
    "capitals": ("1000 * n_capitals div greatest(word_chars, 1)", 300, False),
    "word_length": ("10 * word_chars div greatest(n_words, 1)", 30, True),
}
#: Documents that a group must have for quartiles of its own.
MIN_GROUP = 30
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]


def _left(text: Column, chars: str) -> Column:
    """How many characters of a class a text has."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with COUNTS, each from the whole text.

    n_repeat_words: windows of five words are compared by 64-bit hashes. Only documents with an equal pair pay for
    sorting; the words covered by repeated windows are counted from the windows' places in order.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    kept = docs.columns
    d = docs.withColumn("__w", words(F.col(text)))
    d = d.withColumn("n_words", F.size("__w").cast("long")).withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    window = lambda i: F.xxhash64(*[F.expr("__h")[i + k] for k in range(5)])
    d = d.withColumn("__g", F.when(F.col("n_words") >= 6, F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 5), window)).otherwise(F.expr("cast(array() as array<bigint>)")))
    pairs = F.sort_array(F.transform("__g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    d = d.withColumn("__s", F.when(F.size(F.array_distinct("__g")) < F.size("__g"), pairs).otherwise(F.expr("cast(array() as array<struct<x:bigint,i:int>>)")))
    twice = F.filter("__s", lambda e, j: (F.get(F.col("__s"), j + 1)["x"] == e["x"]) | (F.get(F.col("__s"), j - 1)["x"] == e["x"]))
    places = F.array_sort(F.transform(twice, lambda e: e["i"]))
    covered = F.aggregate(places, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-5).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(5), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("n_repeat_words", covered).withColumn("__lines", lines)
    return d.select(
        *kept,
        "n_words",
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        _left(t, "#*$%&|<>").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("__lines").cast("long").alias("n_lines"),
        _left(t, r"\p{Lu}").alias("n_capitals"),
    )


def bucket(value: Column) -> Column:
    """The least value of a sketch's bucket."""
    wide = F.greatest(F.length(F.bin(value)) - 10, F.lit(0))
    return F.when(value < 1024, value).otherwise(F.call_function("shiftleft", F.call_function("shiftright", value, wide), wide))


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, measure, value, n: the sketches, a row for each bucket that has counts."""
    each = F.array(*[F.struct(F.lit(k).alias("measure"), bucket(F.expr(f"cast({sql} as bigint)")).alias("value")) for k, (sql, _, _) in MEASURES.items()])
    return measured.select("lang", "source", F.explode(each).alias("e")).groupBy("lang", "source", "e.measure", "e.value").agg(F.count("*").alias("n"))


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Each group's number of documents and its quartiles by nearest rank, from sketches merged down to keys."""
    keys = [*keys, "measure"]
    upto = Window.partitionBy(*keys).orderBy("value")
    whole = Window.partitionBy(*keys)
    merged = sketch.groupBy(*keys, "value").agg(F.sum("n").alias("n"))
    placed = merged.withColumn("upto", F.sum("n").over(upto)).withColumn("docs", F.sum("n").over(whole))
    at = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("docs"), F.col("value")))
    return placed.groupBy(*keys).agg(F.max("docs").alias("docs"), at(1).alias("q1"), at(3).alias("q3"))


def fences(sketch: DataFrame, min_group: int = MIN_GROUP, spread: int = 3) -> DataFrame:
    """lang, source and, for each measure, <measure>_hi (and _lo): a row for each source of a language."""
    own = _quartiles(sketch, ["lang", "source"]).alias("o")
    lang = _quartiles(sketch, ["lang"]).alias("l")
    every = _quartiles(sketch, []).alias("e")
    both = own.join(lang, F.col("o.lang").eqNullSafe(F.col("l.lang")) & (F.col("o.measure") == F.col("l.measure"))).join(every, F.col("o.measure") == F.col("e.measure"))
    pick = lambda c: F.when(F.col("o.docs") >= min_group, F.col(f"o.{c}")).when(F.col("l.docs") >= min_group, F.col(f"l.{c}")).otherwise(F.col(f"e.{c}"))
    least = F.create_map(*[x for k, (_, w, _) in MEASURES.items() for x in (F.lit(k), F.lit(w).cast("long"))])
    got = both.select("o.lang", "o.source", "o.measure", pick("q1").alias("q1"), pick("q3").alias("q3")).withColumn("w", F.greatest(spread * (F.col("q3") - F.col("q1")), least[F.col("measure")]))
    of = lambda k, c: F.max(F.when(F.col("measure") == k, c))
    return got.groupBy("lang", "source").agg(*[of(k, F.col("q3") + F.col("w")).alias(f"{k}_hi") for k in MEASURES], *[of(k, F.col("q1") - F.col("w")).alias(f"{k}_lo") for k, (_, _, low) in MEASURES.items() if low])


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def verdicts(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """measured with base_failed and kept; limits: what fences() gives for the same groups."""
    beyond = F.lit(False)
    for k, (sql, _, low) in MEASURES.items():
        value = F.expr(f"cast({sql} as bigint)")
        beyond = beyond | (value > F.col(f"__f.{k}_hi"))
        if low:
            beyond = beyond | (value < F.col(f"__f.{k}_lo"))
    same = F.col("__m.lang").eqNullSafe(F.col("__f.lang")) & F.col("__m.source").eqNullSafe(F.col("__f.source"))
    joined = measured.alias("__m").join(limits.alias("__f"), same, "left")
    # one condition over both sides: parts over measures alone would be pushed below them, and compute them again
    return joined.select("__m.*", base_failed().alias("base_failed"), (~F.coalesce(base_failed() | beyond, base_failed())).alias("kept"))


def judge(docs: DataFrame, min_group: int = MIN_GROUP, spread: int = 3) -> DataFrame:
    """doc_id, lang, source, COUNTS, base_failed and kept for each row of docs. Texts are read once."""
    measured = cut(measure(docs.select("doc_id", "lang", "source", "text")).drop("text"), "measured")
    limits = cut(fences(sketches(measured), min_group, spread), "fences")
    return verdicts(measured, sized(limits))


def keep_good(docs: DataFrame, min_group: int = MIN_GROUP, spread: int = 3) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns.

    Texts are measured twice, once for the sketches and once to filter each row where it lies, so none is shuffled.
    """
    limits = cut(fences(sketches(measure(docs.select("lang", "source", "text"))), min_group, spread), "fences")
    own = docs.select(F.struct(*docs.columns).alias("__row"), "lang", "source", "text")
    return verdicts(measure(own), sized(limits)).where("kept").select("__row.*")
