"""Embedding of texts with an injected model, in Arrow batches."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CountMismatch, DimensionMismatch, EmptyEmbeddings
from ..functions import text as tx


class Embedder(Protocol):
    """Vectors for texts, in order; dimension 0 means that any is accepted."""

    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Bag of words in hash buckets, of length one: the offline stand-in, equal to functions.vectors.hash_embedding."""

    def __init__(self, dimension: int = 32):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        import hashlib

        import regex

        out = []
        for text in texts:
            v = np.zeros(self.dimension)
            for w in regex.findall(r"[\p{L}\p{Nd}]+", (text or "").lower()):
                v[int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % self.dimension] += 1
            n = np.sqrt((v * v).sum())
            out.append((v / n if n else v).tolist())
        return out


def checked(vectors: list, count: int, dimension: int) -> list:
    """The vectors, if there are as many as asked for, none is empty, and all have the dimension."""
    if len(vectors) != count:
        raise CountMismatch(f"{len(vectors)} of {count}")
    for v in vectors:
        if v is None or len(v) == 0:
            raise EmptyEmbeddings()
        if dimension and len(v) != dimension:
            raise DimensionMismatch(f"{len(v)} of {dimension}")
    return vectors


def embed_column(text: Column, embedder: Embedder, batch: int = 32, workers: int = 8) -> Column:
    """The vector of each text. Batches of a task go to a bounded pool; the first error ends the task."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with ThreadPoolExecutor(max(1, workers)) as pool:
            for series in parts:
                texts = series.fillna("").tolist()
                jobs = [pool.submit(embedder.embed, texts[i : i + batch]) for i in range(0, len(texts), batch)]
                out: list = []
                for i, job in zip(range(0, len(texts), batch), jobs):
                    out += checked(job.result(), len(texts[i : i + batch]), embedder.dimension)
                yield pd.Series([np.asarray(v, np.float32) for v in out])

    return run(text)


def embed_chunks(chunks: DataFrame, embedder: Embedder, batch: int = 32, workers: int = 8) -> DataFrame:
    """Adds the embedding of each chunk's index text."""
    return chunks.withColumn("embedding", embed_column(tx.index_text(F.col("context"), F.col("content")), embedder, batch, workers))


def embed_searches(searches: DataFrame, embedder: Embedder, batch: int = 32, workers: int = 8) -> DataFrame:
    """Vectors of the searches that look into the vector store; equal texts are embedded once."""
    wanted = searches.where(F.col("target").isin("all", "dense"))
    texts = wanted.select("text").distinct()
    return wanted.join(texts.withColumn("vector", embed_column(F.col("text"), embedder, batch, workers)), "text")


class RateLimited:
    """An embedder that waits for its turn and tries again after temporary errors, with growing random pauses.

    per_second is the share of one worker: divide a global rate by the number of tasks. Errors with a true `temporary`
    attribute and HTTP statuses 429 and 5xx are tried again; wrong counts and dimensions never are.
    """

    def __init__(self, inner: Embedder, per_second: float, attempts: int = 3, base: float = 0.1, most: float = 5.0, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        if per_second <= 0 or attempts <= 0 or base < 0 or most < base:
            raise ValueError("rate, attempts and pauses must be positive and in order")
        self.inner, self.pause, self.attempts, self.base, self.most = inner, 1.0 / per_second, attempts, base, most
        self._sleep, self._clock, self._next = sleep, clock, 0.0

    @property
    def dimension(self) -> int:
        return self.inner.dimension

    @staticmethod
    def temporary(error: Exception) -> bool:
        if isinstance(error, (CountMismatch, DimensionMismatch, EmptyEmbeddings)):
            return False
        status = getattr(error, "status", None)
        return bool(getattr(error, "temporary", False)) or status == 429 or (isinstance(status, int) and status >= 500)

    def embed(self, texts: list[str]) -> list[list[float]]:
        for attempt in range(self.attempts):
            now = self._clock()
            if now < self._next:
                self._sleep(self._next - now)
            self._next = max(now, self._next) + self.pause
            try:
                return self.inner.embed(texts)
            except Exception as error:
                if attempt + 1 == self.attempts or not self.temporary(error):
                    raise
                self._sleep(random.uniform(0, min(self.most, self.base * 2**attempt)))
        raise AssertionError("unreachable")
