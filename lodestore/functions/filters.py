"""Metadata filters: a dict becomes one column, which Catalyst pushes to wherever it can be tested first.

A filter is a conjunction over keys. A value is compared type-strictly, a list means any of, and a dict holds
operators: $eq $ne $in $nin $gt $gte $lt $lte. A missing key is false for every operator, $ne and $nin included.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import META_VALUE, meta_value

_NUMBERS = ("int", "float")
_ORDER = {"$gt": operator.gt, "$gte": operator.ge, "$lt": operator.lt, "$lte": operator.le}


def _same(held: Column, value) -> Column:
    """Equal in kind and in value."""
    m = meta_value(value)
    tests = [held["t"] == m["t"]]
    tests += [held[k].eqNullSafe(F.lit(m[k])) for k in ("s", "d", "b") if m[k] is not None]
    return reduce(operator.and_, tests)


def _any_of(held: Column, values) -> Column:
    return reduce(operator.or_, (_same(held, v) for v in values), F.lit(False))


def _operator(held: Column, op: str, value) -> Column | None:
    """The test of one operator; None for one that is ignored."""
    if op == "$eq":
        return _same(held, value)
    if op == "$ne":
        return ~_same(held, value)
    if op == "$in":
        return _any_of(held, value) if isinstance(value, (list, tuple)) else F.lit(False)
    if op == "$nin":
        return ~_any_of(held, value) if isinstance(value, (list, tuple)) else None
    if op in _ORDER:
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            return F.lit(False)
        return held["t"].isin(*_NUMBERS) & _ORDER[op](held["d"], F.lit(float(value)))
    return _same(held, value)


def compile_filter(where: dict | None, meta: Column) -> Column:
    """The filter as a boolean column that is never null."""
    if not where:
        return F.lit(True)
    tests: list[Column] = []
    for key, wanted in where.items():
        held = F.element_at(meta, key)
        tests.append(F.coalesce(F.map_contains_key(meta, key), F.lit(False)))
        if isinstance(wanted, dict):
            tests += [t for op, v in wanted.items() if (t := _operator(held, op, v)) is not None]
        elif isinstance(wanted, (list, tuple)):
            tests.append(_any_of(held, wanted))
        else:
            tests.append(_same(held, wanted))
    return F.coalesce(reduce(operator.and_, tests), F.lit(False))


def to_chroma(where: dict | None) -> dict | None:
    """The filter in the language of the Chroma server: every clause an operator, several joined by $and."""
    if not where:
        return None
    clauses = []
    for key, wanted in where.items():
        if isinstance(wanted, dict):
            clauses += [{key: {op: v}} for op, v in wanted.items()]
        elif isinstance(wanted, (list, tuple)):
            clauses.append({key: {"$in": list(wanted)}})
        else:
            clauses.append({key: {"$eq": wanted}})
    return clauses[0] if len(clauses) == 1 else {"$and": clauses}


def to_qdrant(where: dict | None, prefix: str = "metadata.") -> dict | None:
    """The filter in the language of the Qdrant server; operators it lacks are left out."""
    if not where:
        return None
    must, must_not = [], []
    for key, wanted in where.items():
        name = prefix + key
        ops = wanted if isinstance(wanted, dict) else {"$in": wanted} if isinstance(wanted, (list, tuple)) else {"$eq": wanted}
        span = {op[1:]: v for op, v in ops.items() if op in _ORDER}
        if span:
            must.append({"key": name, "range": span})
        for op, v in ops.items():
            if op == "$eq":
                must.append({"key": name, "match": {"value": v}})
            elif op == "$ne":
                must_not.append({"key": name, "match": {"value": v}})
            elif op == "$in":
                must.append({"key": name, "match": {"any": list(v)}})
            elif op == "$nin":
                must_not.append({"key": name, "match": {"any": list(v)}})
    return {k: v for k, v in (("must", must), ("must_not", must_not)) if v} or None


__all__ = ["META_VALUE", "compile_filter", "to_chroma", "to_qdrant"]
