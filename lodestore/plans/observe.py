"""Counters, stage times and spans in the driver process; Spark's own job descriptions carry the stage names."""

from __future__ import annotations

import threading
import time
from bisect import bisect_left
from collections import Counter, defaultdict
from contextlib import contextmanager

BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
STAGES = ("ingest", "rewrite", "embed", "dense", "sparse", "fusion", "rerank", "generate")


class Metrics:
    def __init__(self):
        self._lock = threading.Lock()
        self.counters: Counter = Counter()
        self.histograms: dict[str, list[int]] = defaultdict(lambda: [0] * (len(BUCKETS) + 1))

    def count(self, name: str, by: int = 1) -> None:
        with self._lock:
            self.counters[name] += by

    def observe(self, stage: str, seconds: float) -> None:
        with self._lock:
            self.histograms[stage][bisect_left(BUCKETS, seconds)] += 1


class Tracer:
    """Keeps finished spans: name, parent, seconds, attributes, error."""

    def __init__(self):
        self.spans: list[dict] = []
        self._local = threading.local()

    @contextmanager
    def span(self, name: str, **attributes):
        stack = self._local.__dict__.setdefault("stack", [])
        one = {"name": name, "parent": stack[-1] if stack else None, "attributes": attributes, "error": None}
        stack.append(name)
        began = time.monotonic()
        try:
            yield one["attributes"]
        except BaseException as error:
            one["error"] = f"{type(error).__name__}: {error}"
            raise
        finally:
            stack.pop()
            one["seconds"] = time.monotonic() - began
            self.spans.append(one)


METRICS = Metrics()


@contextmanager
def stage(name: str, spark=None, metrics: Metrics = METRICS, tracer: Tracer | None = None, **attributes):
    """Times a stage; names the Spark jobs it starts."""
    began = time.monotonic()
    if spark is not None:
        spark.sparkContext.setJobDescription(f"lodestore {name}")
    try:
        if tracer is None:
            yield attributes
        else:
            with tracer.span(name, **attributes) as held:
                yield held
    finally:
        metrics.observe(name, time.monotonic() - began)
        if spark is not None:
            spark.sparkContext.setJobDescription(None)
