"""Ranked search: BM25 over postings, with a query language of words, phrases, prefixes, AND, OR, NOT and NEAR.

Postings hold (vault, term, path, positions); statistics are per vault. A query reads the postings of its terms only
(pushed down to the reader; a table sorted by term skips the rest), groups them once by file, and never reads texts.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.errors import EngineError
from quillspark.functions.lexical import fold_tokens, stem, stems
from quillspark.functions.text import has_prefix
from quillspark.operators.merge import Result, check_limit

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


@dataclass
class Index:
    """narrow: makes an index of some terms alone (a set of them, and starts of terms); without it all are there."""

    postings: DataFrame
    files: DataFrame
    stemmed: bool
    narrow: Callable[[set[str], tuple[str, ...]], Index] | None = None

    def terms(self, text: str) -> list[str]:
        return stems(text) if self.stemmed else re.findall(r"[^\W_]+", text.lower())


def plain_words(text: Column) -> Column:
    """Runs of letters and digits in lower case, by built-in functions alone; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def plain_index(files: DataFrame) -> Index:
    """Words as they are, not stemmed."""
    each = files.select("vault", "path", F.posexplode(plain_words(F.col("content"))).alias("pos", "term"))
    postings = each.groupBy("vault", "term", "path").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    return Index(postings, files.select("vault", "path", F.size(plain_words(F.col("content"))).cast("long").alias("dl")), False)


def plain_rows(files: DataFrame, by: list[str] = ("vault", "path")) -> DataFrame:
    """by, term, positions, dl: postings of words as they are, and for each file a row without a term that has its
    number of words (null if its content is null). Each file's are made from its own row: by sorting its words with
    their places and cutting where the word changes. Nothing is grouped or moved, and no row is made for a place.
    """
    worded = files.select(*by, "content", plain_words(F.col("content")).alias("words"))
    length = F.when(F.col("content").isNotNull(), F.size("words")).cast("long")
    placed = F.sort_array(F.transform("words", lambda w, i: F.struct(w.alias("term"), i.alias("pos"))))

    def cut(x: Column) -> Column:
        """The postings of sorted (term, pos)."""
        n = F.size(x)
        at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(at, lambda i: F.coalesce(F.get(x, i)["term"] != F.get(x, i - 1)["term"], F.lit(True)))
        runs = F.arrays_zip(starts.alias("start"), F.slice(F.concat(starts, F.array(n)), 2, n + 1).alias("end"))
        whole = lambda r: F.struct(F.get(x, r["start"])["term"].alias("term"), F.transform(F.sequence(r["start"], r["end"] - 1), lambda i: F.get(x, i)["pos"]).alias("positions"))  # noqa: E731  slice would copy all of x each time
        return F.transform(F.filter(runs, lambda r: r["start"].isNotNull()), whole)

    made = worded.select(*by, length.alias("dl"), F.flatten(F.transform(F.array(placed), cut)).alias("postings"))
    own = F.struct(F.lit(None).cast("string").alias("term"), F.array().cast("array<int>").alias("positions"))
    each = made.select(*by, "dl", F.explode(F.concat(F.array(own), "postings")).alias("p"))
    return each.select(*by, "p.term", "p.positions", F.when(F.col("p.term").isNull(), F.col("dl")).alias("dl"))


def porter_rows(files: DataFrame, wanted: set[str] | None = None, starts: tuple[str, ...] = ()) -> DataFrame:
    """vault, term, path, positions, dl (the file's number of tokens): tokens without accents, stemmed.

    A file's postings are made where it lies, without a shuffle; a file without tokens has one row, its term null.
    wanted, starts: only these terms and those that start so.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for b in batches:
            rows: list[tuple] = []
            for vault, path, content in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                places: dict[str, list[int]] = {}
                own = stems(content or "", known)
                n = len(own)
                for i, t in enumerate(own):
                    if wanted is None or t in wanted or starts and t.startswith(starts):
                        places.setdefault(t, []).append(i)
                rows += [(vault, t, path, p, n) for t, p in places.items()] or [(vault, None, path, [], 0)]
            if rows:
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in c[:3]), pa.array(c[3], pa.list_(pa.int32())), pa.array(c[4], pa.int64())], names=["vault", "term", "path", "positions", "dl"])

    return files.select("vault", "path", "content").mapInArrow(run, "vault string, term string, path string, positions array<int>, dl long")


def postings_of(rows: DataFrame) -> DataFrame:
    """The postings of porter_rows."""
    return rows.where(F.col("term").isNotNull()).drop("dl")


def lengths_of(rows: DataFrame) -> DataFrame:
    """vault, path, dl: a row for each file of porter_rows."""
    return rows.groupBy("vault", "path").agg(F.max("dl").alias("dl"))


def porter_lengths(files: DataFrame) -> DataFrame:
    """vault, path, dl: the number of tokens of each file, which takes no stemming."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array([len(fold_tokens(x.as_py() or "")) for x in b.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], names=["vault", "path", "dl"])

    return files.select("vault", "path", "content").mapInArrow(run, "vault string, path string, dl long")


def porter_index(files: DataFrame) -> Index:
    """An index made from texts on the spot; a scan stores one (quillspark.plans.engine.stored_index)."""
    lengths = porter_lengths(files)
    some = lambda wanted, starts: Index(postings_of(porter_rows(files, wanted, starts)), lengths, True)
    return Index(postings_of(porter_rows(files)), lengths, True, some)


# --- queries: ("phrase", id), ("and", a, b), ("or", a, b), ("not", a, b), ("near", ids, distance)

_LEX = re.compile(r'\s*(?:"((?:[^"]|"")*)"(\s*\*)?|(NEAR)\s*\(|([()+^])|,\s*(\d+)|((?:-\s*)?(?:\w+|\{[\w\s]*\}))\s*:|([\w]+)(\s*\*)?|(\S))')


def parse(query: str, terms_of) -> tuple[tuple | None, list[tuple[list[str], bool, bool]]]:
    """The query's tree, and its phrases: (terms, is the last a prefix?, must it be at the start?)."""
    tokens, at = [], 0
    while at < len(query.rstrip()):
        m = _LEX.match(query, at)
        at = m.end()
        if m[9]:
            raise EngineError("invalid_query", f"syntax error near {m[9]!r}")
        if m[6] is not None:
            tokens.append(("column", m[6]))
        elif m[3]:
            tokens.append(("near", None))
        elif m[4]:
            tokens.append((m[4], None))
        elif m[5]:
            tokens.append(("distance", int(m[5])))
        elif m[7] in ("AND", "OR", "NOT"):
            tokens.append((m[7], None))
        else:
            text = m[1].replace('""', '"') if m[1] is not None else m[7]
            tokens.append(("text", (text, bool(m[2] or m[8]))))
    phrases: list[tuple[list[str], bool, bool]] = []
    place = 0

    def peek():
        return tokens[place][0] if place < len(tokens) else None

    def take(kind=None):
        nonlocal place
        if kind and peek() != kind:
            raise EngineError("invalid_query", f"syntax error: expected {kind!r}")
        place += 1
        return tokens[place - 1][1]

    def phrase(first: bool = False):
        text, prefix = take("text")
        terms = terms_of(text)
        while peek() == "+":
            take()
            text, prefix = take("text")
            terms = [*terms, *terms_of(text)]
        phrases.append((terms, prefix, first))
        return len(phrases) - 1

    def primary():
        kind = peek()
        if kind == "(":
            take()
            out = either()
            take(")")
            return out
        if kind == "column":
            text = take()
            names = re.findall(r"\w+", text)
            for name in names:
                if name not in ("content", "path"):
                    raise EngineError("invalid_query", f"no such column: {name}")
            if peek() == "column":
                raise EngineError("invalid_query", "a column filter needs an expression")
            inner = primary()
            return inner if ("content" in names) != text.startswith("-") else ("never", inner)
        if kind == "near":
            take()
            ids, distance = [], 10
            while peek() == "text":
                ids.append(phrase())
            if peek() == "distance":
                distance = take()
            take("near" if peek() is None else ")")
            if not ids:
                raise EngineError("invalid_query", "NEAR needs phrases")
            return ("near", ids, distance)
        if kind == "^":
            take()
            return ("phrase", phrase(first=True))
        if kind == "text":
            return ("phrase", phrase())
        raise EngineError("invalid_query", f"syntax error near {kind!r}")

    def joined():
        out = primary()
        while peek() in ("text", "(", "column", "near", "^"):
            out = ("and", out, primary())
        return out

    def without():
        out = joined()
        while peek() == "NOT":
            take()
            out = ("not", out, joined())
        return out

    def both():
        out = without()
        while peek() == "AND":
            take()
            out = ("and", out, without())
        return out

    def either():
        out = both()
        while peek() == "OR":
            take()
            out = ("or", out, both())
        return out

    tree = either() if tokens else None
    if place < len(tokens):
        raise EngineError("invalid_query", f"syntax error near {tokens[place][0]!r}")
    return tree, phrases


def _minus(k: int):
    return lambda x: x - k


def _kth(k: int):
    return lambda c: F.get(c, F.lit(k))


def _nears(tree: tuple) -> list[tuple]:
    return [tree] if tree[0] == "near" else [n for t in tree[1:] if isinstance(t, tuple) for n in _nears(t)]


def _clumps(ids: list[int], phrases: list, distance: int) -> Column:
    """Places of the phrases, a list for each clump: from any place on, each phrase's next, if there are at most
    `distance` tokens between each one and the start of the last."""
    starts = F.array_distinct(F.flatten(F.array(*[F.col(f"p{i}") for i in ids])))
    following = lambda m: F.array(*[F.array_min(F.filter(F.col(f"p{i}"), lambda y: y >= m)) for i in ids])
    sizes = [len(phrases[i][0]) for i in ids]
    near = lambda c: functools.reduce(Column.__and__, [F.array_max(c) - F.get(c, F.lit(k)) - n <= distance for k, n in enumerate(sizes)])
    return F.filter(F.transform(starts, following), lambda c: (F.size(F.array_compact(c)) == len(ids)) & near(c))


def _holds(tree: tuple, phrases: list) -> Column:
    kind = tree[0]
    if kind == "phrase":
        return F.size(f"p{tree[1]}") > 0
    if kind == "never":
        return F.lit(False)
    if kind == "near":
        return F.size(f"near{tree[1][0]}") > 0
    a, b = _holds(tree[1], phrases), _holds(tree[2], phrases)
    return a & b if kind == "and" else a | b if kind == "or" else a & ~b


def bm25(index: Index, query: str, prefix: str | None = None) -> DataFrame:
    """vault, path, score of the files that match; lower scores are better."""
    tree, phrases = parse(query, index.terms)
    if tree is None or not any(t for t, _, _ in phrases):
        raise EngineError("invalid_query", "the query has no term")
    if index.narrow:
        starts = {t[-1] for t, last, _ in phrases if t and last}
        index = index.narrow({x for t, _, _ in phrases for x in t}, tuple(sorted(starts)))
    wanted = F.lit(False)
    for terms, last, _ in phrases:
        for k, t in enumerate(terms):
            wanted = wanted | (F.col("term").startswith(t) if last and k == len(terms) - 1 else F.col("term") == t)
    places, empty = [], F.expr("cast(array() as array<int>)")
    for i, (terms, last, _) in enumerate(phrases):
        for k, t in enumerate(terms):
            is_term = F.col("term").startswith(t) if last and k == len(terms) - 1 else F.col("term") == t
            places.append(F.flatten(F.collect_list(F.when(is_term, F.transform("positions", _minus(k))))).alias(f"p{i}_{k}"))
    hits = index.postings.where(wanted).groupBy("vault", "path").agg(*places)
    for i, (terms, _, first) in enumerate(phrases):
        own = F.array_distinct(f"p{i}_0") if terms else empty
        for k in range(1, len(terms)):
            own = F.array_intersect(own, F.col(f"p{i}_{k}"))
        if first:
            own = F.filter(own, lambda x: x == 0)
        hits = hits.withColumn(f"p{i}", own)
    counted = {i: F.size(f"p{i}") for i in range(len(phrases))}
    for _, ids, distance in _nears(tree):  # only places in a clump count there
        hits = hits.withColumn(f"near{ids[0]}", _clumps(ids, phrases, distance))
        for k, i in enumerate(ids):
            counted[i] = F.size(F.array_distinct(F.transform(f"near{ids[0]}", _kth(k))))
    of_vault = index.files.groupBy("vault").agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl"))
    having = hits.groupBy("vault").agg(*[F.count_if(F.size(f"p{i}") > 0).alias(f"n{i}") for i in range(len(phrases))])
    stats = of_vault.join(having, "vault")
    rows = hits.where(_holds(tree, phrases)).join(index.files, ["vault", "path"]).join(stats, "vault")
    if (c := has_prefix(F.col("path"), prefix)) is not None:
        rows = rows.where(c)
    score = F.lit(0.0)
    for i in range(len(phrases)):
        idf = F.ln((F.col("docs") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        tf = counted[i].cast("double")
        score = score - F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.select("vault", "path", score.alias("score"))


def search_ranked(index: Index, query: str, prefix: str | None = None, limit: int = 100) -> Result:
    """vault, path, score, rank: the best files of all vaults, ties by path and vault."""
    rows = bm25(index, query, prefix)
    order = [F.col("score"), F.col("path"), F.col("vault")]
    best = rows.orderBy(*order).limit(check_limit(limit))
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("int"))
    return Result(ranked, rows.limit(limit + 1).groupBy().count().where(F.col("count") > limit))


__all__ = ["Index", "bm25", "parse", "plain_index", "porter_index", "search_ranked", "stem"]
