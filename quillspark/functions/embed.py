"""Embedders: a deterministic one for tests, and batches that shrink when a service refuses them."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

from quillspark.errors import EngineError

Embedder = Callable[[Sequence[str]], list[list[float]]]


class Refused(Exception):
    """A service took no batch of this size (or, of one text, that text)."""


class Unavailable(Exception):
    """A service can't be reached just now."""


def hash_embedder(dims: int) -> Embedder:
    """FNV-1a of each dimension's number and the text, centred and normalised."""

    def one(text: str) -> list[float]:
        out = []
        for d in range(dims):
            h = 0xCBF29CE484222325
            for b in d.to_bytes(4, "little") + text.encode():
                h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
            out.append(h / 2**64 - 0.5)
        norm = math.sqrt(sum(x * x for x in out)) or 1.0
        return [x / norm for x in out]

    return lambda texts: [one(t) for t in texts]


def in_batches(embed: Embedder, texts: Sequence[str], dims: int | None, batch: int = 16, retries: int = 1, pause: float = 0.25) -> list[list[float]]:
    """Vectors of all texts. A refused batch is halved; the size learned is kept once a batch of several has passed, so
    one text that is too long on its own account doesn't slow down the others."""
    out: list[list[float]] = []
    at, most = 0, max(1, batch)
    size = most
    while at < len(texts):
        part = texts[at : at + size]
        try:
            got = _patiently(embed, part, retries, pause)
        except Refused:
            if len(part) == 1:
                raise
            size = len(part) // 2
            continue
        if len(got) != len(part) or any(len(v) != (dims or len(v)) for v in got):
            raise EngineError("embedding_unavailable", "the service's vectors don't fit the request")
        out += got
        at += len(part)
        if len(part) > 1 and size < most:
            most = size
        size = most
    return out


def _patiently(embed: Embedder, part: Sequence[str], retries: int, pause: float) -> list[list[float]]:
    for attempt in range(retries + 1):
        try:
            return embed(part)
        except Unavailable as e:
            if attempt == retries:
                raise EngineError("embedding_unavailable", str(e)) from e
            time.sleep(pause)
    raise AssertionError


def by_index(rows: list[dict]) -> list[list[float]]:
    """A response's vectors in the order of the request: indices are absent, or a permutation."""
    found = [r.get("index") for r in rows]
    if all(i is None for i in found):
        return [r["embedding"] for r in rows]
    if sorted(i for i in found if i is not None) != list(range(len(rows))):
        raise EngineError("embedding_unavailable", "the response's indices aren't a permutation")
    return [r["embedding"] for r in sorted(rows, key=lambda r: r["index"])]


def embed_chunks(chunks: DataFrame, embed: Embedder, dims: int, batch: int = 16) -> DataFrame:
    """chunks with a column embedding. It is null for all rows of a file of which the service takes a text not at all,
    and for what is left of a batch when the service is down, so that files stay searchable."""

    def by_file(x: pd.DataFrame) -> list:
        out: list = [None] * len(x)
        places = x.reset_index(drop=True).groupby(["vault", "file_path"], sort=False, dropna=False).indices
        for own in places.values():
            try:
                for i, v in zip(own, in_batches(embed, [x["content"].iloc[i] for i in own], dims, batch), strict=True):
                    out[i] = v
            except (EngineError, Refused) as e:
                if isinstance(e.__cause__, Unavailable):
                    break
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            try:
                vectors = in_batches(embed, list(x["content"]), dims, batch)
            except (EngineError, Refused) as e:
                vectors = [None] * len(x) if isinstance(e.__cause__, Unavailable) else by_file(x)
            yield x.assign(embedding=vectors)

    return chunks.mapInPandas(run, ", ".join(f"{n} {t}" for n, t in chunks.dtypes) + ", embedding array<float>")
