"""Embedding: the client contract, batching, retries, splitting over-long texts and pooling them back.

A client runs inside a partition (``embed``), so the number of partitions bounds the requests in flight.
"""

from __future__ import annotations

import hashlib
import math
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.chunkers.base import heuristic_tokens

Vector = list[float]


class Client(Protocol):
    """What a backend must offer; documents and queries may be embedded differently."""

    name: str
    dim: int
    max_input_tokens: int

    def embed_documents(self, texts: list[str]) -> list[Vector]: ...
    def embed_query(self, text: str) -> Vector: ...
    def count_tokens(self, text: str) -> int: ...


class Transient(Exception):
    """Worth another try: too many requests, a server's error, a broken connection."""

    def __init__(self, message: str = "", retry_after: float | None = None) -> None:
        super().__init__(message)
        self.retry_after = retry_after


class TooLong(Exception):
    """The input is over the server's limit."""


class HashClient:
    """Deterministic vectors from SHA-256; the same as ``quarry.functions.vectors.hash_embedding``."""

    name = "hash"

    def __init__(self, dim: int = 64, max_input_tokens: int = 8192) -> None:
        self.dim, self.max_input_tokens = dim, max_input_tokens

    def embed_query(self, text: str) -> Vector:
        raw: list[float] = []
        counter = 0
        while len(raw) < self.dim:
            block = hashlib.sha256(f"{text}\0{counter}".encode()).digest()
            raw += [float(int.from_bytes(block[k : k + 8], "big") - 2**63) for k in range(0, 32, 8)]
            counter += 1
        size = math.sqrt(sum(x * x for x in raw[: self.dim]))
        return [x / size for x in raw[: self.dim]]

    def embed_documents(self, texts: list[str]) -> list[Vector]:
        return [self.embed_query(t) for t in texts]

    def count_tokens(self, text: str) -> int:
        return heuristic_tokens(text)


def batches(sizes: list[int], max_texts: int, max_tokens: int) -> list[list[int]]:
    """Positions in order, in batches within both limits; an input over the limit is alone."""
    out: list[list[int]] = []
    total = 0
    for k, n in enumerate(sizes):
        if out and out[-1] and len(out[-1]) < max_texts and total + n <= max_tokens:
            out[-1].append(k)
            total += n
        else:
            out.append([k])
            total = n
    return out


def mean_pooled(vectors: list[Vector | None], dim: int) -> Vector | None:
    """The mean at unit length; None if a piece is missing, of another length, or the mean is zero."""
    if not vectors or any(v is None or len(v) != dim for v in vectors):
        return None
    mean = [sum(c) / len(vectors) for c in zip(*vectors, strict=True)]
    size = math.sqrt(sum(x * x for x in mean))
    return [x / size for x in mean] if size > 0 else None


def bisected(text: str, fits: Callable[[str], bool]) -> list[str]:
    """Halves, of halves, until each fits (or is one character)."""
    out, pending = [], [text]
    while pending:
        t = pending.pop()
        if len(t) <= 1 or fits(t):
            out.append(t)
        else:
            pending += [t[len(t) // 2 :], t[: len(t) // 2]]
    return out


#: Backoff: first wait, growth, longest wait.
FIRST, GROWTH, LONGEST = 1.0, 2.0, 30.0


class Resilient:
    """A client with batches, retries, splitting and quarantine; failed inputs give None, in place."""

    def __init__(self, client: Client, max_texts: int = 32, max_tokens: int | None = None, retries: int = 5, sleep: Callable[[float], None] = time.sleep) -> None:
        self.client, self.max_texts, self.retries, self.sleep = client, max_texts, retries, sleep
        self.max_tokens = max_tokens or client.max_input_tokens * 4
        self.reserve = 0  # tokens that the server's prompt takes

    def probe(self) -> int:
        """Asks for a far too long input and reads from the refusal what the server's prompt takes."""
        try:
            self.client.embed_query("x " * 8 * self.client.max_input_tokens)
        except TooLong as e:
            found = re.search(r"Given:\s*(\d+)", str(e))
            if found:
                own = self.client.count_tokens("x " * 8 * self.client.max_input_tokens)
                self.reserve = max(0, int(found[1]) - own) + 1
        except Transient:
            raise
        return self.reserve

    def fits(self, text: str) -> bool:
        return self.client.count_tokens(text) <= self.client.max_input_tokens - self.reserve

    def _usable(self, v: Vector | None) -> Vector | None:
        return v if v is not None and len(v) == self.client.dim and all(map(math.isfinite, v)) else None

    def _call(self, texts: list[str]) -> list[Vector | None]:
        wait = FIRST
        for attempt in range(self.retries + 1):
            try:
                out = self.client.embed_documents(texts)
                return [self._usable(v) for v in out] if len(out) == len(texts) else [None] * len(texts)
            except Transient as e:
                if attempt == self.retries:
                    return [None] * len(texts)
                self.sleep(min(LONGEST, e.retry_after if e.retry_after is not None else wait))
                wait *= GROWTH
            except TooLong:
                if len(texts) > 1:
                    return [v for t in texts for v in self._call([t])]
                halves = [texts[0][: len(texts[0]) // 2], texts[0][len(texts[0]) // 2 :]]
                return [mean_pooled(self._call(halves), self.client.dim)] if len(texts[0]) > 1 else [None]
            except Exception:  # noqa: BLE001  a refusal for good: each input on its own
                return [None] if len(texts) == 1 else [v for t in texts for v in self._call([t])]
        return [None] * len(texts)

    def embed(self, texts: list[str]) -> list[Vector | None]:
        """A vector or None for each text; over-long ones are split before and pooled after."""
        pieces, owner = [], []
        for k, t in enumerate(texts):
            own = [t] if self.fits(t) else bisected(t, self.fits)
            pieces += own
            owner += [k] * len(own)
        found: list[Vector | None] = [None] * len(pieces)
        for batch in batches([self.client.count_tokens(p) for p in pieces], self.max_texts, self.max_tokens):
            for k, v in zip(batch, self._call([pieces[k] for k in batch]), strict=True):
                found[k] = v
        by: list[list[Vector | None]] = [[] for _ in texts]
        for k, v in zip(owner, found, strict=True):
            by[k].append(v)
        return [vs[0] if len(vs) == 1 else mean_pooled(vs, self.client.dim) for vs in by]


BACKENDS: dict[str, Callable[..., Client]] = {"hash": HashClient}


def client(backend: str, **options: object) -> Client:
    if backend not in BACKENDS:
        raise ValueError(f"unknown backend {backend}; known: {sorted(BACKENDS)}")
    return BACKENDS[backend](**options)


def embed(rows: DataFrame, text: str, make: Callable[[], Client], in_flight: int | None = None, **options: object) -> DataFrame:
    """``rows`` with ``vector`` (null where the input failed for good); the client is made once in each partition."""
    rows = rows.repartition(in_flight) if in_flight else rows  # a shuffle, so that what comes before keeps its tasks
    names = rows.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        resilient = Resilient(make(), **options)
        for part in parts:
            yield part[names].assign(vector=resilient.embed([t or "" for t in part[text]]))

    from pyspark.sql import types as T

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("vector", T.ArrayType(T.DoubleType()))]))
