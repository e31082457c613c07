"""SimHash near-duplicates by a self-join of binary tries of fingerprints.

Equal fingerprints fall together first (summed before the shuffle). Two fingerprints that differ in at most `budget`
of 64 bits agree in one of budget + 1 blocks, so each fingerprint goes into that many tries, one with each block at
the root; tries of the same root block are joined with themselves where they lie. A join goes down pairs of nodes
level by level, adds up differing bits, and drops a pair once they exceed the budget. Nothing is capped: all links
inside a trie are found, and their components leave it as stars, so no trie emits more rows than it holds. Stars of
all tries are joined into components by alternating large-star and small-star steps on written tables.

Defined results: null and empty texts have the fingerprint zero and are linked like others; texts with fewer words
than a shingle are one shingle; a null doc_id is never a component's name unless there's no other; repeated rows each
get a row; an empty table gives an empty one; other columns are ignored by `near_duplicates`, kept by `one_of_each`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm._common import TEXTS, cut, join_dealt, join_hot, partitions, sized

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Shingle hashes counted at a time, and pairs of nodes looked at at a time.
BLOCK, FRONTIER = 1 << 15, 1 << 19
#: Words of 64 bits of a wide fingerprint, whose halves of 32 bits are looked up with as many errors, and further words
#: that pairs found there must about agree in. Candidates of sets up to SMALL shingles come from shared shingles instead,
#: and must about agree in all MORE further words.
WIDE, HALF, ERRORS, CHECK, MORE, SMALL = 8, 32, 3, 1, 4, 64
#: Words in all, of the few that have candidates.
ALL = 32
#: A candidate pair: the second one's place in the turn's order.
PAIR = ["a", "b", "place"]
#: Hashes that a part of a trie may have in all where sets are compared (two parts meet in a task), and pairs of sets
#: compared at a time.
HASHES, SETS = 1 << 22, 1 << 14


def fingerprint(text: str | None, k: int = 3, seed: int = 42) -> int:
    """The 64 bits that are set in over half of the hashes of the text's shingles of k words."""
    found = _WORDS.findall((text or "").translate(_LOWER))
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(found) < k:
        found, k = [" ".join(found)], 1
    shingles = map(" ".join, zip(*(found[i:] for i in range(k)), strict=False))
    return int(_majority(np.array([digest(s, seed) for s in shingles], np.uint64)))


def _majority(hashes: np.ndarray) -> np.uint64:
    """The bits that are set in over half of the hashes. Sums of 255 bits fit in a byte, and are taken so."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = hashes[i : i + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        rows = max(1, -(-len(part) // 255))
        bits = np.zeros((255 * rows, 64), np.uint8)
        bits[: len(part)] = np.unpackbits(part, axis=1)
        counts += bits.reshape(255, rows, 64).sum(0, dtype=np.uint8).sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes)).view(">u8")[0].astype(np.uint64)


def shingle_set(text: str | None, k: int = 5, seed: int = 42) -> np.ndarray:
    """The different hashes of the text's shingles of k words, in order."""
    found = _WORDS.findall((text or "").translate(_LOWER))
    if len(found) < k:
        found, k = [" ".join(found)] if found else [], 1
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, seed) for s in map(" ".join, zip(*(found[i:] for i in range(k)), strict=False))], np.uint64))


def wide_fingerprint(hashes: np.ndarray, words: range = range(WIDE + MORE)) -> np.ndarray:  # noqa: B008
    """Several words of 64 such bits, each of other mixtures of the hashes; 0 for those before the ones asked for."""
    out = np.zeros(words.stop, np.uint64)
    for i in words:  # a step of the splitmix64 generator
        z = hashes + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[i] = _majority(z ^ (z >> np.uint64(31)))
    return out


def fingerprints(docs: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, text_hash, fp (the fingerprint as a signed long) for each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([fingerprint(x.as_py(), k, seed) for x in b.column(2)], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got)], names=["doc_id", "text_hash", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long")


def _stars(links: np.ndarray, n: int) -> np.ndarray:
    """Each place's least place reachable by links (pairs of places)."""
    root = np.arange(n)
    while True:
        a, b = root[links[:, 0]], root[links[:, 1]]
        if (a == b).all():
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def trie_join(tries: np.ndarray, codes: np.ndarray, budget: int, top: int) -> np.ndarray:
    """For each code the least place of its component within its trie."""
    n = len(codes)
    root = np.arange(n)
    for links in trie_links(tries, codes, budget, top):
        root = _stars(np.concatenate([links, np.stack([np.arange(n), root], 1)]), n)
    return root


def trie_links(tries: np.ndarray, codes: np.ndarray, budget: int, top: int, stop: int = 0, label: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Pairs of places within a trie whose codes differ in at most budget bits, each once, some at a time.

    Bits below `stop` aren't looked at on the way down. Nodes that hold one and the same `label` aren't joined.

    tries, codes (unsigned, sorted by trie and code): equal `tries` have equal top bits and form one trie. Pairs of
    nodes are ranges of places; small pairs are compared directly.
    """
    edges = np.flatnonzero(np.r_[True, tries[1:] != tries[:-1], True])
    lo, hi = edges[:-1], edges[1:]
    big = hi - lo > 1
    lo, hi = lo[big], hi[big]
    todo = [(63 - top, np.stack([lo, hi, lo, hi, np.zeros_like(lo)], 1))]
    ones: dict[int, np.ndarray] = {}
    other = None if label is None else np.r_[0, np.cumsum(label[1:] != label[:-1])]
    while todo:
        bit, pairs = todo.pop()
        if len(pairs) > FRONTIER:
            half = len(pairs) // 2
            todo += [(bit, pairs[:half]), (bit, pairs[half:])]
            continue
        if other is not None:
            a0, a1, b0, b1, _ = pairs.T
            pairs = pairs[(other[a0] != other[a1 - 1]) | (other[b0] != other[b1 - 1]) | (label[a0] != label[b0])]
        size = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
        leaf = (size <= 64) | (bit < stop)
        yield from _compare(codes, pairs[leaf], budget)
        pairs = pairs[~leaf]
        if not len(pairs):
            continue
        if bit not in ones:
            ones[bit] = np.r_[0, np.cumsum((codes >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)]
        c = ones[bit]
        a0, a1, b0, b1, e = pairs.T
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        own = a0 == b0
        down = [np.stack(x, 1) for x in ((a0, am, b0, bm, e), (am, a1, bm, b1, e), (a0, am, bm, b1, e + 1))]
        down.append(np.stack((am, a1, b0, bm, e + 1), 1)[~own])
        new = np.concatenate(down)
        new = new[(new[:, 1] > new[:, 0]) & (new[:, 3] > new[:, 2]) & (new[:, 4] <= budget) & ~((new[:, 0] == new[:, 2]) & (new[:, 1] - new[:, 0] == 1))]
        if len(new):
            todo.append((bit - 1, new))


def _compare(codes: np.ndarray, pairs: np.ndarray, budget: int, at_once: int = 1 << 20) -> Iterator[np.ndarray]:
    """The linked places of pairs of nodes, some at a time however large a pair is."""
    size = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
    upto = np.cumsum(size)
    for start in range(0, int(upto[-1]) if len(pairs) else 0, at_once):
        k = np.arange(start, min(start + at_once, int(upto[-1])))
        of = np.searchsorted(upto, k, "right")
        k -= (upto - size)[of]
        wide = (pairs[:, 3] - pairs[:, 2])[of]
        a, b = pairs[of, 0] + k // wide, pairs[of, 2] + k % wide
        near = (np.bitwise_count(codes[a] ^ codes[b]) <= budget) & ((a < b) | (pairs[of, 0] != pairs[of, 2]))
        if near.any():
            yield np.stack([a[near], b[near]], 1)


def _links(budget: int, top: int, many: int = 1 << 16):
    def flush(trie: np.ndarray, code: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        root = trie_join(trie, code.view(np.uint64), budget, top)
        own = root != np.arange(len(root))
        return pa.RecordBatch.from_arrays([pa.array(fp[own]), pa.array(fp[root[own]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by trie and code. Whole tries are joined, many small ones at a time."""
        held: list[list[np.ndarray]] = []
        rows = 0
        for b in batches:
            held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            rows += b.num_rows
            if rows >= many:
                x = [np.concatenate(c) for c in zip(*held, strict=True)]
                stop = int(np.flatnonzero(np.r_[True, x[0][1:] != x[0][:-1]])[-1])  # the last trie may go on
                held, rows = [[c[stop:] for c in x]], len(x[0]) - stop
                if stop:
                    yield flush(*(c[:stop] for c in x))
        if rows:
            yield flush(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def links(distinct: DataFrame, budget: int = 3) -> DataFrame:
    """a, b: links between fingerprints (column fp, each once) that connect all that differ in at most budget bits."""
    blocks = budget + 1
    top = 64 // blocks
    turn = lambda i: F.shiftleft("fp", i * top).bitwiseOR(F.shiftrightunsigned("fp", 64 - i * top)) if i else F.col("fp")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), turn(i).alias("code")) for i in range(blocks)]))
    tries = distinct.select("fp", each.alias("x")).select((F.shiftrightunsigned("x.code", 64 - top) * blocks + F.col("x.i")).alias("trie"), F.col("x.code").alias("code"), "fp")
    # order as unsigned numbers
    ordered = tries.repartition(partitions(distinct.sparkSession), "trie").sortWithinPartitions("trie", F.col("code").bitwiseXOR(F.lit(-(1 << 63)).cast("long")))
    return ordered.mapInArrow(_links(budget, top), "a long, b long")


def stars(edges: DataFrame) -> DataFrame:
    """a, b for edges (a, b): each node but the least of its component, with the least.

    Large-star and small-star steps by turns; each reads and writes a table, and stops when the table stays the same.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    was = None
    while True:
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == was or not now[0]:
            return e
        was = now
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = cut(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "small")


def near_duplicates(docs: DataFrame, k: int = 3, budget: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, text_hash, fp, component_id, first_hash for each row of docs.

    component_id: the least doc_id that is reachable; first_hash: the text_hash of that document.
    """
    fps = cut(fingerprints(docs, k, seed), "fingerprints", TEXTS)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    distinct = cut(fps.groupBy("fp").agg(first, F.count("*").alias("n")), "distinct")
    joined = cut(stars(links(distinct, budget)), "stars")
    named = cut(_named(distinct, joined), "named")
    return join_hot(fps, named, ["fp"], "n").select("doc_id", "text_hash", "fp", F.col("first.doc_id").alias("component_id"), F.col("first.text_hash").alias("first_hash"))


def _trie_of(code: Column) -> Column:
    """The trie that a row's code is in: a shared shingle's own (negative codes), or that of its first bits."""
    return F.when(code < 0, code).otherwise(F.shiftright(code, HALF - HALF // (ERRORS + 1)))


def _by_trie(flush, many: int = 1 << 16):
    """Rows come by code. Whole tries go to flush (trie, and the rows' columns), many small ones at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for b in batches:
            cols = [np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c)] if not c.null_count else c.to_numpy(zero_copy_only=False) for c in b.columns]
            held.append([np.where(cols[0] < 0, cols[0], cols[0] >> (HALF - HALF // (ERRORS + 1))), *cols])
            rows += b.num_rows
            if rows >= many:
                x = [np.concatenate(c) for c in zip(*held, strict=True)]
                stop = int(np.flatnonzero(np.r_[True, x[0][1:] != x[0][:-1]])[-1])  # the last trie may go on
                held, rows = [[c[stop:] for c in x]], len(x[0]) - stop
                if stop:
                    yield from flush(*(c[:stop] for c in x))
        if rows:
            yield from flush(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def _pairs(trie: np.ndarray, code: np.ndarray, size: np.ndarray, label: np.ndarray, exact: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places that a trie has in common, with different labels and sizes that similar sets may have."""
    # codes to the left end, as trie_links has them; shared shingles have none
    at = np.where(code < 0, 0, code).astype(np.uint64) << np.uint64(64 - HALF)
    for links in trie_links(trie, at, ERRORS, HALF // (ERRORS + 1), 64 - HALF, label):
        links = links[label[links[:, 0]] != label[links[:, 1]]]
        # no sets are more similar than the smaller one's share of the larger one's size
        n = np.sort(size[links], axis=1)
        a, b = links[n[:, 0] * exact.denominator >= n[:, 1] * exact.numerator].T
        yield a, b


def _candidates(far: int, small: int, exact: Fraction, turn: int, many: int = 1 << 16):
    """Candidate pairs (a, b, place of b) of rows (code, key, check words, size), by code: for each key that has one, the
    one that comes first in the turn's order."""
    factor = np.uint64((2 * turn + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)  # odd: each key has a place of its own

    def flush(trie: np.ndarray, code: np.ndarray, key: np.ndarray, *more: np.ndarray) -> Iterator[pa.RecordBatch]:
        place = key.view(np.uint64) * factor >> np.uint64(2)
        check = [c.view(np.uint64) for c in more[:MORE]]  # signed ones would be counted by their absolute values
        best = np.full(len(key), (1 << 64) - 1, np.uint64)
        of = np.arange(len(key))
        for a, b in _pairs(trie, code, more[MORE], key, exact):
            bits = sum(np.bitwise_count(c[a] ^ c[b]).astype(int) for c in check)
            kept = bits <= np.where(code[a] < 0, small, far)
            a, b = np.r_[a[kept], b[kept]], np.r_[b[kept], a[kept]]  # each has the other for a candidate
            order = np.argsort(place[b], kind="stable")[::-1]
            a, b = a[order], b[order]
            nearer = place[b] < best[a]
            of[a[nearer]], best[a[nearer]] = b[nearer], place[b[nearer]]  # the last one counts: the least
        own = np.flatnonzero(of != np.arange(len(key)))
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[own], key[of[own]], best[own].astype(np.int64))], names=PAIR)

    return _by_trie(flush, many)


def _near(words: list[np.ndarray], code: np.ndarray, a: np.ndarray, b: np.ndarray, far: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose fingerprints differ in at most `far` bits (of all words; of those after the wide ones, where a set
    has no others), in the first of their common tries alone; the nearest first."""
    wide = (words[0][a] != 0) & (words[0][b] != 0)
    bits = sum(np.bitwise_count(c[a] ^ c[b]).astype(int) for c in words[WIDE:])
    bits = bits + np.where(wide, sum(np.bitwise_count(c[a] ^ c[b]).astype(int) for c in words[:WIDE]), 0)
    kept = np.flatnonzero(bits <= np.where(wide, *far))
    a, b, bits = a[kept], b[kept], bits[kept] * np.where(wide[kept], ALL - WIDE, ALL)
    own, halves = np.ones(len(a), bool), np.flatnonzero(code[a] >= 0)
    own[halves] = code[a[halves]] >> HALF == _first_code(words[:WIDE], a[halves], b[halves])
    order = np.argsort(bits[own], kind="stable")
    return a[own][order], b[own][order]


def _open(far: tuple[int, int], exact: Fraction):
    """code, key, size of those rows (code, key, all words, size, label), by code, that are near one of another label in
    their trie: each row once, however many are near it."""

    def flush(trie: np.ndarray, code: np.ndarray, key: np.ndarray, *more: np.ndarray) -> Iterator[pa.RecordBatch]:
        words, (size, label) = [c.view(np.uint64) for c in more[:ALL]], more[ALL:]
        found = np.zeros(len(key), bool)
        for a, b in _pairs(trie, code, size, label, exact):
            a, b = _near(words, code, a, b, far)
            found[a] = found[b] = True
        if found.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[found]) for x in (code, key, size)], names=["code", "key", "size"])

    return _by_trie(flush)


def _linked(far: tuple[int, int], exact: Fraction, many: int = 1 << 12):
    """Labels a, b to be linked, from rows (trie, lo, hi, part, code, size, label, fp, hashes), by trie, lo, hi and code.

    Sets of different labels that are near are compared by all their hashes where they lie, the nearest first; once two
    labels are linked, their other sets need no comparison. A task's links leave it as stars, so it never gives more rows
    than it has labels. Rows of different parts meet where lo and hi differ, those of one part where they don't.
    """

    def flush(t: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        code, part, size = (t[c].to_numpy() for c in ("code", "part", "size"))
        names, label = np.unique(t["label"].to_numpy(), return_inverse=True)
        words = list(np.frombuffer(b"".join(t["fp"].to_pylist()), np.uint64).reshape(len(code), ALL).T.copy())
        sets = t["hashes"].combine_chunks()
        hashes, start = sets.flatten().to_numpy().view(np.uint64), np.r_[0, np.cumsum(size)]
        across = t["lo"].to_numpy() != t["hi"].to_numpy()
        root = np.arange(len(names))
        for a, b in _pairs(group, code, size, label, exact):
            other = (part[a] != part[b]) | ~across[a]
            a, b = _near(words, code, a[other], b[other], far)
            while len(a):
                apart = root[label[a]] != root[label[b]]
                a, b = a[apart], b[apart]
                now = _similar(hashes, start, a[:SETS], b[:SETS], exact)
                links = np.stack([label[a[:SETS][now]], label[b[:SETS][now]]], 1)
                root = _stars(np.concatenate([links, np.stack([np.arange(len(root)), root], 1)]), len(root))
                a, b = a[SETS:], b[SETS:]
        own = root != np.arange(len(root))
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array(names[own]), pa.array(names[root[own]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = full = 0

        def grouped() -> tuple[pa.Table, np.ndarray]:
            t = pa.Table.from_batches(held)
            trie, lo, hi = (t[c].to_numpy() for c in ("trie", "lo", "hi"))
            return t, np.r_[0, np.cumsum((trie[1:] != trie[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))]

        for b in batches:
            held.append(b)
            rows, full = rows + b.num_rows, full + pc.sum(b["size"]).as_py()
            if rows >= many or full >= HASHES:
                t, group = grouped()
                stop = int(np.searchsorted(group, group[-1]))  # the last group may go on
                held, rows, full = t.slice(stop).to_batches(), t.num_rows - stop, 0
                if stop:
                    yield from flush(t.slice(0, stop), group[:stop])
        if rows:
            yield from flush(*grouped())

    return run


def _similar(hashes: np.ndarray, start: np.ndarray, a: np.ndarray, b: np.ndarray, exact: Fraction, at_once: int = 1 << 20) -> np.ndarray:
    """Which pairs of sets are similar enough; set i is hashes[start[i] : start[i + 1]], each hash once, in order."""
    size = np.diff(start)
    common = np.zeros(len(a), np.int64)
    order = np.argsort(a, kind="stable")
    for same in np.split(order, np.flatnonzero(np.diff(a[order])) + 1) if len(a) else []:
        own = hashes[start[a[same[0]]] : start[a[same[0]] + 1]]
        upto = np.cumsum(size[b[same]])
        for some in np.split(same, np.flatnonzero(np.diff(upto // at_once)) + 1):
            n = size[b[some]]
            begin = np.cumsum(n) - n
            other = hashes[np.arange(n.sum()) + np.repeat(start[b[some]] - begin, n)]
            place = np.searchsorted(own, other)
            hit = own[np.minimum(place, len(own) - 1)] == other
            common[some] = np.add.reduceat(hit, begin, dtype=np.int64)
    return common * (exact.numerator + exact.denominator) >= (size[a] + size[b]) * exact.numerator


def _first_code(words: list[np.ndarray], a: np.ndarray, b: np.ndarray, at_once: int = 1 << 16) -> np.ndarray:
    """The number of the first trie that pairs of rows have in common, by their words: its turn, and which half-word."""
    size = HALF // (ERRORS + 1)
    out = np.full(len(a), -1)
    for i in range(0, len(a), at_once):
        x = np.ascontiguousarray(np.stack([w[a[i : i + at_once]] ^ w[b[i : i + at_once]] for w in words], 1)).view(np.uint32)
        close = np.bitwise_count(x) <= ERRORS
        # a turn's trie is of the block that comes to the left end
        same = np.concatenate([close & ((x << np.uint32(t * size)) >> np.uint32(HALF - size) == 0) for t in range(ERRORS + 1)], 1)
        out[i : i + at_once] = np.where(same.any(1), same.argmax(1), -1)
    return out


def _tries(whole: bool):
    """Rows (code, key, check words, size, label if there) of tries for rows (key, fp, tokens, size, and perhaps label).

    Rows of half-words have CHECK check words and 0 for the others; with `whole` all rows have all words. A code holds the
    half-word's number and turn above its 32 turned bits, or a shared shingle with the highest bit."""
    codes, size = 64 // HALF * WIDE, HALF // (ERRORS + 1)
    width, n_check = (ALL, ALL) if whole else (WIDE + MORE, MORE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, *label = (b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns) if i not in (1, 2))
            names = ["code", "key", *(f"check{i}" for i in range(n_check)), "size", *(["label"] if len(label) > 1 else [])]
            fps = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint64).reshape(len(key), width)
            check = fps[:, width - n_check :].view(np.int64)
            tokens = [np.frombuffer(x, np.uint64) for x in b.column(2).to_pylist()]
            n = np.array([len(x) for x in tokens])
            row = np.repeat(np.arange(len(key)), n)
            if len(row):  # a shared shingle is a trie of its own, in which all codes are equal
                code = (np.concatenate(tokens) | np.uint64(1 << 63)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (code, key[row], *check[row].T.copy(), *(x[row] for x in label))], names=names)
            wide = fps[:, 0] != 0
            half = np.ascontiguousarray(fps[wide, :WIDE]).view(np.uint32).reshape(-1, codes).astype(np.uint64)
            narrow = check[wide] if whole else np.where(np.arange(MORE) < CHECK, check[wide], 0)
            rest = [pa.array(x) for x in (key[wide], *narrow.T.copy(), *(x[wide] for x in label))]
            for block in range(ERRORS + 1):
                turned = (half << np.uint64(block * size) | half >> np.uint64(HALF - block * size)) & np.uint64((1 << HALF) - 1)
                for i in range(codes):
                    yield pa.RecordBatch.from_arrays([pa.array(turned[:, i].astype(np.int64) + (block * codes + i << HALF)), *rest], names=names)

    return run


def similar_groups(docs: DataFrame, k: int = 5, similarity: float = 0.8, sure: bool = False) -> DataFrame:
    """doc_id, text_hash, first_id, first_hash: each row of docs, and which document stands for its group.

    Two documents are linked if the Jaccard similarity of their sets of k-word shingles (64-bit hashes) of the whole
    texts is at least that; groups are the components. Only candidates are compared, all of them exactly:

    Sets over SMALL shingles have wide fingerprints; each half-word is a code of its own, with tries that allow ERRORS
    errors, and pairs found there must be near in CHECK further words, with 3.5 standard deviations granted. Sets whose
    sizes alone are too different aren't compared. A pair just
    at the threshold is found by at least one code with a probability of about 0.99, closer ones nearly surely.
    Smaller sets are compared if they share one of the first shingles in the order of hashes, as many as similar sets
    can't all differ in; that finds all, but for what the check words miss (one in some thousands).

    sure: compares all sets so, without check words. No link is missed; there are more candidates, and a fifth of each
    set's shingles is shuffled.

    Candidates are first looked at one per document and trie, so that large groups link up by a few comparisons each.
    Then only documents that have candidates are left, with their whole fingerprints: of each trie those rows stay that
    are near one of another group, and take their sets along. There all pairs that aren't in one group yet are compared,
    each in one trie alone, and only links leave a task: no row is made for a pair that isn't similar enough. Tries
    with more than HASHES hashes are dealt out by pairs of parts.
    """
    exact = Fraction(str(similarity))
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi  # of bits that differ, for sets of one size
    allowed = lambda p, words: int(64 * words * p + 3.5 * math.sqrt(64 * words * p * (1 - p)))
    far, small = allowed(share, CHECK), allowed(1.25 * share, MORE)  # 4 of 5 shingles: 0.1875
    all_far = (allowed(share, ALL), allowed(1.25 * share, ALL - WIDE))
    most = 1 << 62 if sure else SMALL
    both = int(most / exact)  # a set of `most` may be similar to one of this size
    if sure:
        far, small, all_far = 64 * MORE, 64 * MORE, (64 * ALL, 64 * ALL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for x in b.column(2):
                h = shingle_set(x.as_py(), k)
                fp = wide_fingerprint(h, range(WIDE if len(h) <= most else 0, WIDE + MORE))
                fp[0] = fp[0] | np.uint64(fp[0] == 0) if len(h) > most else 0
                first = h[: len(h) - math.ceil(exact * len(h)) + 1] if 0 < len(h) <= both else h[:0]
                for o, v in zip(out, (xxhash.xxh64_intdigest(h.tobytes()), fp.tobytes(), first.tobytes(), len(h)), strict=True):
                    o.append(v)
            cols = [pa.array(np.array(out[0], np.uint64).view(np.int64)), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["doc_id", "text_hash", "key", "fp", "tokens", "size"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    fps = cut(hashed.mapInArrow(run, f"doc_id {id_type}, text_hash long, key long, fp binary, tokens binary, size long"), "wide-fingerprints", TEXTS)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    named = cut(fps.groupBy("key").agg(first, F.count("*").alias("n"), F.min("fp").alias("fp"), F.min("tokens").alias("tokens"), F.min("size").alias("size")), "shingle-sets")

    def found(nodes: DataFrame, look, out: str) -> DataFrame:
        whole = "label" in nodes.columns
        words = "".join(f", check{i} long" for i in range(ALL if whole else MORE)) + ", size long" + (", label long" if whole else "")
        rows = nodes.mapInArrow(_tries(whole), f"code long, key long{words}")
        ordered = rows.repartition(partitions(docs.sparkSession), _trie_of(F.col("code"))).sortWithinPartitions("code")
        return cut(ordered.mapInArrow(look, out), "candidates")

    pairs = found(named.select("key", "fp", "tokens", "size"), _candidates(far, small, exact, 0), ", ".join(f"{c} long" for c in PAIR))
    ends = cut(pairs.select(F.col("a").alias("key")).distinct().join(named, "key"), "ends")
    # the text of one document of each set: others with that set stay where they are
    one = ends.select("key", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"))
    same = hashed["doc_id"].eqNullSafe(one["doc_id"]) & (hashed["text_hash"] == one["text_hash"])
    texts = hashed.join(sized(one), same).groupBy("key").agg(F.first("text").alias("text"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(x.as_py(), k).view(np.int64) for x in b.column(1)], pa.list_(pa.int64()))], names=["key", "hashes"])

    sets = cut(texts.mapInArrow(hashes, "key long, hashes array<long>"), "sets", TEXTS)
    side = lambda pairs, e: pairs.groupBy(e).agg(F.count("*").alias(f"{e}_n")).join(sets.select(F.col("key").alias(e), F.col("hashes").alias(f"{e}_hashes")), e)

    def true(pairs: DataFrame) -> DataFrame:
        """The pairs that are similar enough, by all their hashes."""
        common = F.size(F.array_intersect("a_hashes", "b_hashes")).cast("long")
        near = common * (exact.numerator + exact.denominator) >= (F.size("a_hashes") + F.size("b_hashes")) * exact.numerator
        return join_dealt(join_dealt(pairs, side(pairs, "a"), ["a"], "a_n", ["b"]), side(pairs, "b"), ["b"], "b_n", ["a"]).where(near).select("a", "b")

    def widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            more = [wide_fingerprint(np.array(h.values.to_numpy().view(np.uint64)), range(WIDE + MORE, ALL))[WIDE + MORE :].tobytes() for h in b.column(4)]
            fp = pa.array([x + y for x, y in zip(b.column(1).to_pylist(), more, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), fp, b.column(2), b.column(3)], names=["key", "fp", "tokens", "size"])

    few = cut(ends.join(sets, "key").select("key", "fp", "tokens", "size", "hashes").mapInArrow(widened, "key long, fp binary, tokens binary, size long"), "few")
    best = pairs.groupBy("a").agg(F.min_by("b", "place").alias("b"))
    one = cut(best.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs")
    joined = cut(stars(true(one)), "set-stars")
    # groups are linked from here on, not their documents
    label = F.coalesce("root", "key").alias("label")
    few = few.join(joined.select(F.col("a").alias("key"), F.col("b").alias("root")), "key", "left").select("key", "fp", "tokens", "size", label)
    left = found(few, _open(all_far, exact), "code long, key long, size long").withColumn("trie", _trie_of(F.col("code")))
    last = F.expr(f"cast((sum(size) - 1) div {HASHES} as int)").alias("last")
    wide = F.broadcast(left.groupBy("trie").agg(last).where("last > 0"))
    part, to = F.pmod(F.xxhash64("key"), F.col("last") + 1).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), "last")).alias("to")
    dealt = left.join(wide, "trie", "left").fillna(0, ["last"]).select("trie", "code", "key", part, "last").select("*", to)
    block = [F.least("part", "to").cast("long").alias("lo"), F.greatest("part", "to").cast("long").alias("hi"), F.col("part").cast("long").alias("part")]
    rows = dealt.join(few.select("key", "fp", "size", "label"), "key").join(sets, "key").select("trie", *block, "code", "size", "label", "fp", "hashes")
    ordered = rows.repartition(partitions(docs.sparkSession), "trie", "lo", "hi").sortWithinPartitions("trie", "lo", "hi", "code")
    linked = cut(ordered.mapInArrow(_linked(all_far, exact), "a long, b long"), "links", TEXTS)
    joined = cut(stars(joined.union(linked)), "set-stars")
    names = cut(_named(named.select(F.col("key").alias("fp"), "first", "n"), joined).withColumnRenamed("fp", "key"), "named-sets")
    return join_hot(fps, names, ["key"], "n").select("doc_id", "text_hash", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"))


def _named(distinct: DataFrame, joined: DataFrame) -> DataFrame:
    """fp, first, n: for each fingerprint the first document of its component, given the components' stars."""
    member = joined.select(F.col("a").alias("fp"), F.col("b").alias("root")).union(joined.select(F.col("b").alias("fp"), F.col("b").alias("root")).distinct())
    least = member.join(distinct, "fp").groupBy("root").agg(F.min("first").alias("least"))
    return distinct.join(member.join(least, "root").select("fp", "least"), "fp", "left").select("fp", F.coalesce("least", "first").alias("first"), "n")


def one_of_each(docs: DataFrame, k: int = 5, similarity: float = 0.8, sure: bool = False) -> DataFrame:
    """docs with all their columns, one row of each group: that of the least doc_id, and of its repetitions one.

    Rows that nothing is like or equal to are told from the others by a join with the ids and hashes of those that go or
    are repeated; only repeated ones are shuffled to keep one of them.
    """
    groups = similar_groups(docs, k, similarity, sure)
    leads = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))
    counted = groups.withColumn("leads", leads).groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"), F.max("leads").alias("leads"))
    known = sized(cut(counted.where(~F.col("leads") | (F.col("n") > 1)).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "leads"), "near-copies"))
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("own id"), F.xxhash64("text").alias("own hash"))
    told = own.join(known, own["own id"].eqNullSafe(known["id"]) & (own["own hash"] == known["hash"]), "left")
    alone = told.where(F.col("leads").isNull()).select("row.*")
    repeated = told.where("leads").dropDuplicates(["own id", "own hash"]).select("row.*")
    return alone.unionByName(repeated)
