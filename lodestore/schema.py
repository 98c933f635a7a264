"""Table layouts. One row per document, chunk, posting, hit; metadata values keep their type beside their value."""

from __future__ import annotations

from pyspark.sql import types as T

META_VALUE = T.StructType([T.StructField("t", T.StringType()), T.StructField("s", T.StringType()), T.StructField("d", T.DoubleType()), T.StructField("b", T.BooleanType())])
META = T.MapType(T.StringType(), META_VALUE)

DOCUMENT = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("source", T.StringType()), T.StructField("seq", T.IntegerType()), T.StructField("content", T.StringType()), T.StructField("meta", META)])
CHUNK = T.StructType([T.StructField("chunk_id", T.StringType()), T.StructField("doc_id", T.StringType()), T.StructField("idx", T.IntegerType()), T.StructField("content", T.StringType()), T.StructField("context", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("meta", META)])
SEARCH = T.StructType([T.StructField("query_id", T.StringType()), T.StructField("search_no", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("target", T.StringType())])
HIT = T.StructType([T.StructField("query_id", T.StringType()), T.StructField("search_no", T.IntegerType()), T.StructField("is_dense", T.BooleanType()), T.StructField("is_rewrite", T.BooleanType()), T.StructField("rank", T.IntegerType()), T.StructField("chunk_id", T.StringType()), T.StructField("dense", T.DoubleType()), T.StructField("sparse", T.DoubleType()), T.StructField("score", T.DoubleType())])
TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))

ALL, DENSE, SPARSE = "all", "dense", "sparse"


def meta_value(value) -> dict:
    """A Python value as a META_VALUE: kind, text, number, flag."""
    if isinstance(value, bool):
        return {"t": "bool", "s": None, "d": None, "b": value}
    if isinstance(value, (int, float)):
        return {"t": "int" if isinstance(value, int) else "float", "s": None, "d": float(value), "b": None}
    if isinstance(value, str):
        return {"t": "str", "s": value, "d": None, "b": None}
    import json

    return {"t": "json", "s": json.dumps(value, sort_keys=True), "d": None, "b": None}
