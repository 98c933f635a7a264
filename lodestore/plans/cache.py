"""Opt-in query cache: exact by normalised question, semantic by nearest vector, or both; and the same over tables."""

from __future__ import annotations

import time
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.identity import document_id

EXACT, SEMANTIC, BOTH = "exact", "semantic", "exact then semantic"


class Backend(Protocol):
    def get(self, key: str) -> Any | None: ...

    def set(self, key: str, answer: Any, ttl: float) -> None: ...


class Memory:
    """First in, first out by write: writing a key again makes it newest, reading does not. most <= 0 is unbounded."""

    def __init__(self, most: int = 0, clock: Callable[[], float] = time.monotonic):
        self._most, self._clock, self._held = most, clock, OrderedDict()

    def get(self, key: str):
        answer, expires = self._held.get(key, (None, 0.0))
        if answer is None:
            return None
        if expires and self._clock() >= expires:
            del self._held[key]
            return None
        return answer

    def set(self, key: str, answer, ttl: float) -> None:
        self._held.pop(key, None)
        self._held[key] = (answer, self._clock() + ttl if ttl > 0 else 0.0)
        while self._most > 0 and len(self._held) > self._most:
            self._held.popitem(last=False)

    def __len__(self) -> int:
        return len(self._held)


@dataclass
class Policy:
    mode: str = EXACT
    ttl: float = 0.0
    min_score: float = 0.0
    most_indexed: int = 10_000
    embed: Callable[[str], list[float]] | None = None

    def __post_init__(self):
        if self.mode not in (EXACT, SEMANTIC, BOTH):
            raise ValueError(f"unknown cache mode {self.mode!r}")
        if self.mode != EXACT:
            if not 0 < self.min_score <= 1:
                raise ValueError("a semantic cache needs a minimum score above 0, at most 1")
            if self.embed is None:
                raise ValueError("a semantic cache needs an embedder")
        if self.most_indexed <= 0:
            self.most_indexed = 10_000


def _normal(text: str) -> str:
    return " ".join(text.split()).lower()


@dataclass
class Cached:
    """Wraps retrieve(question, **options) -> answer. Failed and degraded answers are never kept; faults are misses."""

    retrieve: Callable[..., Any]
    backend: Backend
    policy: Policy = field(default_factory=Policy)
    clock: Callable[[], float] = time.monotonic

    def __post_init__(self):
        self._generation = 0
        self._vectors: OrderedDict[str, tuple[str, np.ndarray, float]] = OrderedDict()

    def _scope(self, options: dict) -> str:
        shown = repr((self._generation, sorted((k, repr(v)) for k, v in options.items())))
        return str(uuid.uuid5(uuid.NAMESPACE_URL, shown))

    @staticmethod
    def _key(scope: str, question: str) -> str:
        return str(uuid.uuid5(uuid.NAMESPACE_URL, scope + "\0" + _normal(question)))

    def invalidate(self) -> None:
        """Nothing kept so far answers any more."""
        self._generation += 1
        self._vectors.clear()

    def _nearest(self, scope: str, v: np.ndarray) -> str | None:
        best, found = self.policy.min_score, None
        for key, (held, x, _) in self._vectors.items():
            if held == scope and len(x) == len(v):
                scale = np.linalg.norm(x) * np.linalg.norm(v)
                score = float(x @ v / scale) if scale else 0.0
                if score >= best and (found is None or score > best):
                    best, found = score, key
        return found

    def _index(self, key: str, scope: str, v: np.ndarray) -> None:
        self._vectors.pop(key, None)
        self._vectors[key] = (scope, v, self.clock())
        while self._vectors:
            first = next(iter(self._vectors))
            old = self.policy.ttl > 0 and self.clock() - self._vectors[first][2] >= self.policy.ttl
            if not old and len(self._vectors) <= self.policy.most_indexed:
                break
            self._vectors.popitem(last=False)

    def _try(self, f, *args):
        try:
            return f(*args)
        except Exception:  # noqa: BLE001 - a cache fault is a miss
            return None

    def __call__(self, question: str, **options):
        scope = self._scope(options)
        key = self._key(scope, question)
        if self.policy.mode != SEMANTIC and (hit := self._try(self.backend.get, key)) is not None:
            return hit
        vector = None
        if self.policy.mode != EXACT and (got := self._try(self.policy.embed, question)) is not None:
            vector = np.asarray(got, np.float64)
            near = self._nearest(scope, vector)
            if near is not None:
                if (hit := self._try(self.backend.get, near)) is not None:
                    return hit
                self._vectors.pop(near, None)  # its answer is gone
        answer = self.retrieve(question, **options)
        degraded = any(getattr(answer, name, None) for name in ("rewrite_error", "dense_error"))
        if answer is not None and not degraded:
            self._try(self.backend.set, key, answer, self.policy.ttl)
            if vector is not None:
                self._index(key, scope, vector)
        return answer


# ---- over tables --------------------------------------------------------------------------------------------------


def cache_key(scope: Column, question: Column) -> Column:
    return document_id(scope, tx.normalise(question))


def kept(entries: DataFrame, most: int, now: Column | None = None) -> DataFrame:
    """entries(key, seq, expires): one row per key, the last written; unexpired; per scope the newest `most`."""
    last = entries.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(F.col("seq").desc()))).where("_n = 1").drop("_n")
    if now is not None:
        last = last.where(F.col("expires").isNull() | (F.col("expires") > now))
    if most <= 0:
        return last
    return last.withColumn("_r", F.row_number().over(Window.partitionBy("scope").orderBy(F.col("seq").desc()))).where(F.col("_r") <= most).drop("_r")
