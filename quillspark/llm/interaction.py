"""Filter interaction audit: what filters take away in each order, and how much of it is each one's own doing.

For each part of the corpus (a value of `source`) documents are counted by mask, the set of filters that they fail.
From these counts comes the part's removal polynomial, the multilinear extension of "how many documents does this set
of filters remove": in x_i, the share of filter i that is switched on,

    R(x) = sum over masks m of count(m) * (1 - product over i in m of (1 - x_i)).

A corner of the cube, where each x_i is 0 or 1, is a set of filters; R there is what the set removes, and the rest of
the part survives. A filter's Shapley value is the integral over the cube's diagonal of R's partial derivative by x_i;
it is a sum of rationals with denominators up to the number of filters, kept exact and scaled by the number of orders,
so that it is the number of documents that the filter removes, summed over all orders.

Texts are read once; what is shuffled are a row of a few numbers and a hash for each document. The last step works on
at most 32 counts a part.

Defined results: a null text counts as empty; a null part is the empty string, together with parts that are so; a
null id is neither smaller nor larger than another, so such rows don't fail the filter of copies, and have no labels;
repeated rows each count, and rows that agree in id and text aren't copies of each other; a document with several
labels is good (toxic) if one of them says so; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm._common import cut, join_hot, words

FILTERS = "ABCDE"
AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def conditions(text: Column) -> dict[str, Column]:
    """The failure conditions that a text meets by itself, by filter; E, that of copies, needs the whole table."""
    t, w = F.coalesce(text, F.lit("")), words(text)
    capitals = F.length(t) - F.length(F.regexp_replace(t, "[A-Z]+", ""))
    return {
        "A": F.size(w) < 50,
        "B": 100 * F.size(F.array_distinct(w)).cast("long") < 65 * F.size(w).cast("long"),
        "C": 100 * capitals.cast("long") > 5 * F.length(t).cast("long"),
        "D": t.rlike("[#$%&*|]"),
    }


def _bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def masks(docs: DataFrame, labels: DataFrame, text: str = "text", part: str = "source") -> DataFrame:
    """part, mask, docs, good, toxic: how many documents of a part fail just the filters of the mask (bit 0 is A).

    Copies are found by their texts' SHA-256. A hot text's rows stay where they are; only its hash and first id travel.
    """
    alone = sum((F.when(fails, _bit(k)).otherwise(0) for k, fails in conditions(F.col(text)).items()), F.lit(0))
    facts = docs.select(
        F.col("doc_id").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)).alias("digest"), alone.alias("alone"),
    )
    facts = cut(facts, "filter-facts")
    firsts = cut(facts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "first-copies")
    copy = F.when(F.col("doc_id") > F.col("first"), _bit("E")).otherwise(0)
    failed = join_hot(facts, firsts, ["digest"], "n").groupBy("doc_id", "part", (F.col("alone") + copy).alias("mask")).agg(F.count("*").alias("docs"))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    of = lambda mark: F.coalesce(F.sum(F.when(F.col(mark), F.col("docs"))), F.lit(0)).alias(mark)
    return failed.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.sum("docs").alias("docs"), of("good"), of("toxic"))


class Removal:
    """The removal polynomial of counts by mask: coefficients of the products of x_i over each set of filters."""

    def __init__(self, counts: dict[int, int], filters: int = len(FILTERS)):
        self.filters, self.total = filters, sum(counts.values())
        over = [0] * (1 << filters)  # documents that fail at least the set's filters
        for mask, n in counts.items():
            for s in range(1 << filters):
                if s & mask == s:
                    over[s] += n
        self.terms = [n if s.bit_count() % 2 else -n for s, n in enumerate(over)]
        self.terms[0] = 0
        self.corners = [sum(c for s, c in enumerate(self.terms) if s & at == s) for at in range(1 << filters)]

    def at(self, chosen: int) -> int:
        """The value at a corner: how many documents a set of filters removes."""
        return self.corners[chosen]

    def derivative(self, i: int) -> list[int]:
        """The partial derivative by x_i on the diagonal, where all are t: coefficients of 1, t, t^2 and so on."""
        out = [0] * self.filters
        for s, c in enumerate(self.terms):
            if s >> i & 1:
                out[s.bit_count() - 1] += c
        return out

    def shapley(self, i: int) -> Fraction:
        """The integral of that derivative from 0 to 1."""
        return sum((Fraction(c, k + 1) for k, c in enumerate(self.derivative(i))), Fraction(0))


def steps(docs: dict[int, int], good: dict[int, int], toxic: dict[int, int]) -> Iterator[tuple]:
    """For each order of the filters and each step of it what AUDIT says, without the part."""
    every, (of, of_good, of_toxic) = (1 << len(FILTERS)) - 1, map(Removal, (docs, good, toxic))
    shares = [of.shapley(i) * factorial(len(FILTERS)) for i in range(len(FILTERS))]
    assert all(x.denominator == 1 for x in shares)
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = _bit(name)
            after = before | bit
            removed = of.at(after) - of.at(before)
            alone = of.at(every) - of.at(every ^ bit)
            lost = (r.at(after) - r.at(before) for r in (of_good, of_toxic))
            yield "".join(order), step, of.total - of.at(after), removed, of.at(bit) - removed, alone, *lost, int(shares[FILTERS.index(name)])
            before = after


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", part: str = "source") -> DataFrame:
    """AUDIT: a row for each part, order of the filters and step."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, rows in zip(b["part"], b["rows"], strict=True):
                by = [{r["mask"]: int(r[k]) for r in rows} for k in ("docs", "good", "toxic")]
                yield pd.DataFrame([(name, *s) for s in steps(*by)], columns=[c.split()[0] for c in AUDIT.split(", ")])

    counts = masks(docs, labels, text, part).groupBy("part").agg(F.collect_list(F.struct("mask", "docs", "good", "toxic")).alias("rows"))
    return counts.mapInPandas(run, AUDIT)
