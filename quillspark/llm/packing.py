"""Packing documents into sequences: patterns of few lengths, fitted to the histogram by non-negative least squares.

Documents are tokenised once; those over the sequence length are cut. The driver sees only the histogram of piece
lengths (at most `room` numbers). It enumerates patterns of up to three lengths that fill a sequence, fits how often
each repeats to the histogram by projected gradients, rounds so that no length is used up twice, and packs what is
left best-fit, longest first, group by group of equal sequences. Pieces are then numbered within their length, and
looked up in the patterns' slots: at most room / 2 groups hold at most 63 different lengths each, so the slots have a
fixed bound and are broadcast.

Parts of texts are tokenised once per task and remembered: ids never cross the pre-tokenizer's parts, so a text's ids
are those of its parts in turn. (Texts with a special token's string, or not in normal form, are tokenised whole.)

Defined results: a null or empty text is a piece with the end id alone; repeated rows are packed each; an empty table
gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._common import TEXTS, cut, prefix_sums

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Of how many words, and of how many parts, a worker keeps the ids in each of two generations.
MEMORY = 100_000
#: Python splits at these, the vocabulary doesn't.
_ODD = re.compile(r"[\x1c-\x1f]")


class Memory(dict):
    """What `make` gives for a key. MEMORY keys later a key is forgotten, unless it was asked for in between."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key):
        if len(self) >= MEMORY:
            self.older = dict(self)
            self.clear()
        out = self.older.get(key)
        self[key] = out = self.make(key) if out is None else out
        return out


def _latin(text: str) -> bool:
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


def encoder(vocabulary: str):
    """A function that gives a text's ids as little-endian unsigned 32-bit numbers, by a vocabulary's JSON.

    A text is split at white space, and words as the vocabulary's pre-tokenizer splits them; each different word and
    part is tokenised once and remembered. If the vocabulary puts texts in lower case, so are words in Latin-1 (there
    the two agree, and texts are in normal form), and their parts go to its model directly.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary)
    model = tokenizer.model
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    split, *rest = (json.loads(vocabulary).get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    plain = split.get("type") == "Split" and split["invert"] and "Regex" in split["pattern"] and [(x["type"], x.get("use_regex")) for x in rest] == [("ByteLevel", False)]
    # other vocabularies tokenise whole texts
    lower = plain and tokenizer.normalizer is not None and tokenizer.normalizer.normalize_str("AÉ\t b") == "aé b"
    parts_of = regex.compile(split["pattern"]["Regex"]).findall if lower else None
    # runs of letters are one part each, if what the pattern tries before them begins with an apostrophe
    tries = split["pattern"]["Regex"].split("|") if lower else []
    at = next((i for i, x in enumerate(tries) if x in (r"[\p{L}]+", r"\p{L}+")), None)
    letters_whole = at is not None and all(re.fullmatch(r"'\w*", x) for x in tries[:at])
    # bytes as a byte-level model writes them: itself if it can be seen, else the next free code point from 256
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in seen)}

    def whole(text: str) -> bytes:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def part(x: str) -> bytes:
        seen_as = x if x.isascii() and x.isprintable() else x.encode().decode("latin-1").translate(letters)  # no part has a blank
        ids = [t.id for t in model.tokenize(seen_as)]
        return struct.pack(f"<{len(ids)}I", *ids)

    parts = Memory(part)

    def word(x: str) -> bytes:  # in lower case and Latin-1
        own = [x] if letters_whole and x.isalpha() else parts_of(x)
        return part(own[0]) if len(own) == 1 else b"".join(map(parts.__getitem__, own))

    words, others = Memory(word), Memory(lambda x: word(x.lower()) if _latin(x) else whole(x))

    def encode(text: str) -> bytes:
        if not lower or any(x in text for x in special) or _ODD.search(text):
            return whole(text)
        if _latin(text):
            return b"".join(map(words.__getitem__, text.lower().split()))
        if not unicodedata.is_normalized("NFC", text):  # words might join
            return whole(text)
        return b"".join(map(others.__getitem__, text.split()))

    return encode


def _pieces(vocabulary, room: int, end: int):
    """vocabulary: its JSON, as a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the tasks of a worker share what it remembers, by way of a module that all workers have
        held = pa.__dict__.setdefault("_quillspark_encoders", {})
        key = zlib.crc32(vocabulary.value.encode()), len(vocabulary.value)
        if key not in held:
            held.clear()
            held[key] = encoder(vocabulary.value)
        encode, last = held[key], end.to_bytes(4, "little")
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + last
                for i, at in enumerate(range(0, len(ids), 4 * room)):
                    part = ids[at : at + 4 * room]
                    out.append((doc, i, at // 4, len(part) // 4, zlib.crc32(part)))
            if out:
                c = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), *(pa.array(x, pa.int64()) for x in c[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def patterns(room: int, step: int) -> list[tuple[int, ...]]:
    """Patterns of one to three lengths that fill a sequence; of three, the two longer ones in steps."""
    two = [(a, room - a) for a in range((room + 1) // 2, room)]
    three = [(a, b, room - a - b) for a in range(step, room, step) for b in range(step, a + 1, step) if 0 < room - a - b <= b]
    return [(room,), *two, *three]


def fit(histogram: np.ndarray, shapes: list[tuple[int, ...]], rounds: int = 300) -> np.ndarray:
    """How often each pattern repeats: non-negative least squares by accelerated projected gradients."""
    which = np.concatenate([np.full(len(p), i) for i, p in enumerate(shapes)])
    length = np.concatenate([np.array(p) for p in shapes])
    used = np.bincount(length, minlength=len(histogram))
    step = 1 / max(1.0, float(np.sqrt(used.max() * 9)) * 3, float(used.max()))
    x = y = np.zeros(len(shapes))
    t = 1.0
    for _ in range(rounds):
        left = histogram - np.bincount(length, weights=y[which], minlength=len(histogram))
        new = np.maximum(0, y + step * np.bincount(which, weights=left[length], minlength=len(shapes)))
        t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        x, y = new, new + (was - 1) / t * (new - x)
    return x


def groups(histogram: dict[int, int], room: int, step: int = 8) -> list[tuple[Counter, int]]:
    """Groups of equal sequences: (length -> how many in each sequence, number of sequences), each piece in one."""
    left = np.zeros(room + 1)
    for k, v in histogram.items():
        left[k] = v
    out: list[tuple[Counter, int]] = []
    shapes = patterns(room, step)
    repeats = fit(left, shapes)
    for i in np.argsort(-repeats, kind="stable"):
        if repeats[i] < 0.5:
            break
        need = Counter(shapes[i])
        n = min(int(repeats[i] + 0.5), *(int(left[k]) // m for k, m in need.items()))
        if n:
            out.append((need, n))
            for k, m in need.items():
                left[k] -= n * m
    open_: dict[int, list[tuple[Counter, int]]] = defaultdict(list)  # by room left
    for k in range(room, 0, -1):
        n = int(left[k])
        while n:
            at = min((r for r in open_ if r >= k and open_[r]), default=None)
            if at is None:
                each = min(room // k, n)
                open_[room - each * k].append((Counter({k: each}), n // each))
                n -= n // each * each
            else:
                shape, m = open_[at].pop()
                each = min(at // k, max(1, n // m))
                take = min(m, n // each)
                if take < m:
                    open_[at].append((shape, m - take))
                open_[at - each * k].append((shape + Counter({k: each}), take))
                n -= take * each
    return out + [g for x in open_.values() for g in x]


def slots(found: list[tuple[Counter, int]]) -> np.ndarray:
    """Rows of length, first rank, pieces of that length in each sequence, first sequence, offset; by length and rank."""
    rank: Counter = Counter()
    rows, first = [], 0
    for shape, n in found:
        offset = 0
        for k, m in sorted(shape.items(), reverse=True):
            rows.append((k, rank[k], m, first, offset))
            rank[k] += n * m
            offset += k * m
        first += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def tokenised(docs: DataFrame, vocabulary: str, room: int, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of each document. vocabulary: a path on the driver."""
    with open(vocabulary, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # some megabytes, whatever the corpus
    return docs.select("doc_id", "text").mapInArrow(_pieces(shared, room, end), PIECES)


def pack(docs: DataFrame, vocabulary: str, room: int = 2048, end: int = 0) -> DataFrame:
    """The pieces with sequence_id and offset: a row for each piece of docs (doc_id, text)."""
    place = F.shiftrightunsigned(F.xxhash64("id"), 11) / F.lit(float(1 << 53))  # repeated rows have places of their own
    pieces = tokenised(docs, vocabulary, room, end).withColumn("one", F.lit(1).cast("long")).withColumn("id", F.monotonically_increasing_id())
    pieces = cut(pieces.withColumn("place", place), "pieces", TEXTS)
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `room` rows
    table = docs.sparkSession.sparkContext.broadcast(slots(groups(histogram, room)))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = table.value
        keys = (t[:, 0] << 44) + t[:, 1]
        for x in batches:
            row = t[np.searchsorted(keys, (x["length"].to_numpy() << 44) + x["rank"].to_numpy(), "right") - 1]
            of = x["rank"].to_numpy() - row[:, 1]
            yield x.drop(columns="rank").assign(sequence_id=row[:, 3] + of // row[:, 2], offset=row[:, 4] + of % row[:, 2] * row[:, 0])

    ranked = prefix_sums(pieces, ["length"], ["place", "id"], "one", "upto", "place")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*names, (F.col("upto") - 1).alias("rank")).mapInPandas(look, f"{PIECES}, sequence_id long, offset long")
