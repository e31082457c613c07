"""Toxicity by multiple-instance learning: sentences have scores, a document their noisy-or.

Only documents are labelled. A sentence's evidence is the sum of its features' weights over a bias; what lies above a
floor is its score, so that sentences with little evidence count exactly 0 and a document's score doesn't rise with its
length alone. A document's is 1 - (1 - BASE) * prod(1 - s) over its sentences; weights follow the gradient of the
documents' likelihood, which passes each document's error to the sentences that could explain it, with a penalty that
keeps most at 0. Everything is scored, whole, where it lies, and the sentences that make it toxic are located.

The model is fitted on at most `TRAIN_DOCS` labelled documents, those with the smallest hash of their id, without those
of over `TRAIN_CHARS` characters; each is taken or left for its own length. Features are counted and sentences taken apart on executors; the driver gets the
VOCABULARY chosen features and, per document, which of them meet in a sentence, and fits the weights.

Defined results: a null or empty text has no sentence and the score BASE; without labels, or with labels of one kind,
all scores are BASE; rows with a null doc_id are scored but never learned from; of differing texts with one doc_id the
greatest is learned from; a document with both labels is toxic; repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm._common import cut

#: Labelled documents that the model is fitted on, at most; characters that one may hold; features it looks at.
TRAIN_DOCS, TRAIN_CHARS, VOCABULARY = 6000, 40_000, 2000
#: Evidence of a sentence without features; evidence up to which a sentence counts nothing; the score without evidence.
BIAS, FLOOR, BASE = -7.0, -6.0, 1e-3
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of words' starts that are features of their own.
STARTS = (4, 5, 6)
SPANS = "array<struct<start:int,end:int,score:double>>"


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _words(sentence: str) -> set[str]:
    return set(_WORD.findall(sentence.lower()))


def features(words: set[str]) -> set[str]:
    """Words, and for inflected forms the starts of longer ones, marked with a star."""
    return words | {f"{w[:n]}*" for w in words for n in STARTS if len(w) > n}


def fit(doc: np.ndarray, cell: np.ndarray, feature: np.ndarray, y: np.ndarray, size: int, rounds: int = 400, rate: float = 1.0, penalty: float = 1e-4) -> np.ndarray:
    """The weights of `size` features; doc: each sentence's document, (cell, feature): which sentences have which, y:
    the documents' labels."""
    s, w, seen = len(doc), np.zeros(size), np.full(size, 1e-6)
    quiet = np.log1p(np.exp(FLOOR))  # -log(1 - p) at the floor
    for _ in range(rounds):
        z = np.clip(BIAS + np.bincount(cell, weights=w[feature], minlength=s), -30, 30)
        none = np.bincount(doc, weights=np.minimum(0, quiet - np.log1p(np.exp(z))), minlength=len(y))  # log prod(1 - s)
        whole = np.clip(1 - (1 - BASE) * np.exp(none), 1e-9, 1)
        p = 1 / (1 + np.exp(-z))
        pull = np.where(y[doc] == 1, p * (1 - whole[doc]) / whole[doc], np.where(z > FLOOR, -p, 0)) / len(y)
        g = np.bincount(feature, weights=pull[cell], minlength=size)
        seen = seen + g * g
        step = rate / np.sqrt(seen)
        w = w + step * g
        w = np.sign(w) * np.maximum(0, np.abs(w) - step * penalty)
    return w


def beginnings(weights: dict[str, float]) -> set[str]:
    """The first four letters of each feature that counts: words that start otherwise have none."""
    return {f.rstrip("*")[:4] for f in weights}


def score(text: str, weights: dict[str, float], starts: set[str]) -> tuple[float, list[dict]]:
    """A text's score and its sentences with a score of at least a half; starts: beginnings(weights)."""
    none, spans = 0.0, []
    known = {w for w in _words(text) if w[:4] in starts}
    if known and any(f in weights for f in features(known)):
        quiet = float(np.log1p(np.exp(FLOOR)))
        for m in _SENTENCE.finditer(text):
            hit = [weights[f] for f in features(_words(m[0]) & known) if f in weights]
            loud = min(0.0, quiet - float(np.log1p(np.exp(min(BIAS + sum(hit), 30))))) if hit else 0.0
            none += loud
            if loud <= -np.log(2):
                spans.append({"start": m.start(), "end": m.end(), "score": float(-np.expm1(loud))})
    return 1 - (1 - BASE) * float(np.exp(none)), spans


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """feature, toxic, n for rows (text, toxic): how many texts have it."""
    for b in batches:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for text, toxic in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            seen[toxic].update(features(_words(text.as_py() or "")))
        got = [(f, k, n) for k in (0, 1) for f, n in seen[k].items()]
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.string(), pa.int32(), pa.int64()), strict=True)], names=["feature", "toxic", "n"])


def _sentences(index: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """toxic, hits for rows (text, toxic): the features that meet in each sentence, as bytes after the number of them."""
        for b in batches:
            out = []
            for text, toxic in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                hits = array("i")
                for sentence in _SENTENCE.findall(text.as_py() or ""):
                    hit = sorted({index[f] for f in features(_words(sentence)) if f in index})
                    if hit:
                        hits.append(len(hit))
                        hits.extend(hit)
                out.append((toxic, hits.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["toxic", "hits"])

    return run


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> dict[str, float]:
    """The weights, from labels (doc_id, toxic) of documents that aren't held out."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    # at most train_docs ids: bounded whatever the size of the corpus
    order = (F.md5(F.col("doc_id").cast("string")), "doc_id")
    chosen = own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(*order).limit(train_docs)
    got = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    taken = cut(got.where(F.coalesce(F.length("text"), F.lit(0)) <= train_chars), "labelled-texts").select("text", "toxic")
    n = {r[0]: r[1] for r in taken.groupBy("toxic").agg(F.count("*")).collect()}
    if len(n) < 2:
        return {}
    counts = taken.mapInArrow(_counts, "feature string, toxic int, n long").groupBy("feature").agg(*[F.sum(F.when(F.col("toxic") == k, F.col("n")).otherwise(0)).cast("double").alias(c) for k, c in ((1, "a"), (0, "c"))])
    n1, n0 = float(n[1]), float(n[0])
    gain = F.expr(f"pow(a * ({n0} - c) - c * ({n1} - a), 2) * {n1 + n0} / ({n1} * {n0} * (a + c) * ({n1 + n0} - a - c) + 1e-9)")
    best = counts.where((F.col("a") >= 2) & (F.col("a") / n1 > F.col("c") / n0)).orderBy(gain.desc(), "feature").limit(VOCABULARY)
    chosen_features = [r[0] for r in best.select("feature").collect()]  # at most VOCABULARY
    rows = taken.mapInArrow(_sentences({f: i for i, f in enumerate(chosen_features)}), "toxic int, hits binary").orderBy("toxic", "hits").collect()
    doc, cell, feature = array("l"), array("l"), array("l")
    for d, r in enumerate(rows):
        hits, at = np.frombuffer(r["hits"], np.int32), 0
        while at < len(hits):
            k = int(hits[at])
            cell.extend([len(doc)] * k)
            feature.extend(hits[at + 1 : at + 1 + k].tolist())
            doc.append(d)
            at += 1 + k
    if not doc:
        return {}
    w = fit(np.array(doc, int), np.array(cell, int), np.array(feature, int), np.array([r["toxic"] for r in rows], float), len(chosen_features))
    return {f: float(x) for f, x in zip(chosen_features, w, strict=True) if x != 0}


def classify(docs: DataFrame, model: dict[str, float]) -> DataFrame:
    """doc_id, score, spans (offending sentences) for each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most VOCABULARY weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        starts = beginnings(weights)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for b in batches:
            got = [score(x.as_py() or "", weights, starts) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in got], pa.float64()), pa.array([x[1] for x in got], kind)], names=["doc_id", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, spans {SPANS}")
