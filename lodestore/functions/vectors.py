"""Vector columns. All arithmetic is in double precision, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is all zero; vectors of unlike length are an error."""
    both = norm(a) * norm(b)
    value = F.when(both == 0, F.lit(0.0)).otherwise(dot(a, b) / both)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vector has another dimension")).cast("double")).otherwise(value)


def bucket(term: Column, dim: int) -> Column:
    """The hash bucket of a term: the first 28 bits of its MD5."""
    return (F.conv(F.substring(F.md5(F.encode(term, "utf-8")), 1, 7), 16, 10).cast("bigint") % dim).cast("int")


def hash_embedding(terms: Column, dim: int = 32) -> Column:
    """Bag of words in `dim` hash buckets, of length one; all zero for no terms.

    Every inner value is bound once: buckets by the outer transform, counts and length as lambda variables. Named
    again inside a lambda, they would be computed again for every element.
    """
    zeros = F.array_repeat(F.lit(0.0), dim)
    counts = F.aggregate(F.transform(terms, lambda t: bucket(t, dim)), zeros, lambda acc, b: F.transform(acc, lambda v, i: F.when(i == b, v + 1.0).otherwise(v)))
    scaled = lambda c: F.transform(F.array(norm(c)), lambda n: F.transform(c, lambda x: F.when(n == 0, 0.0).otherwise(x / n)))[0]
    return F.transform(F.array(counts), scaled)[0]
