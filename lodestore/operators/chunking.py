"""Chunkers: documents(doc_id, content, …) to chunks(chunk_id, doc_id, idx, content, …)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import chunk_id

#: Fixed: paragraph, line, word, character.
SEPARATORS = ("\n\n", "\n", " ", "")


def _bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def _windows(text: str, size: int, overlap: int) -> Iterator[str]:
    """Overlapping windows of characters; the last one ends with the text."""
    step = max(1, size - overlap)
    at = 0
    while at < len(text):
        yield text[at : at + size]
        if at + size >= len(text):
            return
        at += step


def _pack(pieces: list[tuple[str, int]], separator: str, size: int, overlap: int) -> Iterator[str]:
    """Joins pieces up to size bytes; a full chunk leaves its newest pieces, at most overlap bytes, to the next one."""
    gap = _bytes(separator)
    held: list[tuple[str, int]] = []
    length = 0
    for piece, n in pieces:
        grown = length + (gap if held else 0) + n
        if grown <= size:
            held.append((piece, n))
            length = grown
            continue
        if held:
            yield separator.join(p for p, _ in held)
        first = 0
        while first < len(held) and length > overlap:
            length -= held[first][1] + gap
            first += 1
        held = held[first:]
        held.append((piece, n))
        length = sum(m for _, m in held) + gap * (len(held) - 1)
    if held:
        yield separator.join(p for p, _ in held)


def split_recursively(text: str, size: int, overlap: int, separators=SEPARATORS) -> list[str]:
    """Cuts at the coarsest separator that occurs; pieces above size are cut again with the finer ones.

    Sizes are UTF-8 bytes; only the last resort, a window over characters, counts characters.
    """
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), None)
    separator, finer = (separators[at], separators[at + 1 :]) if at is not None else (separators[-1], ())
    out: list[str] = []
    run: list[tuple[str, int]] = []
    for piece in text.split(separator) if separator else text:
        n = _bytes(piece)
        if n <= size:
            run.append((piece, n))
            continue
        out += _pack(run, separator, size, overlap)
        run = []
        out += split_recursively(piece, size, overlap, finer) if finer else _windows(piece, size, overlap)
    out += _pack(run, separator, size, overlap)
    return out


def _numbered(documents: DataFrame, pieces: Column) -> DataFrame:
    rows = documents.select("*", F.posexplode(pieces).alias("idx", "_piece")).drop("content").withColumnRenamed("_piece", "content")
    return rows.withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("idx")))


def character_chunks(documents: DataFrame, size: int, overlap: int = 0, separators=SEPARATORS) -> DataFrame:
    """Recursive chunks by size in bytes, numbered from 0."""
    if size <= 0:
        raise ValueError("chunk size must be positive")
    if overlap < 0:
        raise ValueError("chunk overlap must not be negative")
    if overlap >= size:
        raise ValueError("chunk overlap must be smaller than the chunk size")
    separators = tuple(separators) or SEPARATORS

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_recursively(t, size, overlap, separators) if t else [])

    return _numbered(documents, cut(F.col("content")))


def windows_of(tokens: Column, size: int, overlap: int) -> Column:
    """Fixed windows over an array; the last one reaches the end."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("window size must be positive and above its overlap")
    step = size - overlap

    def cut(held: Column) -> Column:
        n = F.size(held)
        count = F.when(n <= 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / F.lit(step)) + 1).cast("int")
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(held, i * step + 1, F.lit(size)))).otherwise(F.array())

    return F.transform(F.array(tokens), cut)[0]  # bound once: named inside the inner lambda, tokens would be cut again per window


def token_chunks(documents: DataFrame, size: int, overlap: int, tokenizer: Callable[[Column], Column] | None = None) -> DataFrame:
    """Windows over the tokens of any tokenizer that is a column function (blank-separated words by default)."""
    tokenizer = tokenizer or (lambda c: F.filter(F.split(c, r"\s+"), lambda x: x != ""))
    return _numbered(documents, F.transform(windows_of(tokenizer(F.col("content")), size, overlap), lambda w: F.array_join(w, " ")))


def bpe_chunks(documents: DataFrame, size: int, overlap: int, encoding: Callable[[], object]) -> DataFrame:
    """Windows over byte-pair tokens; encoding() is called on the workers and gives encode(text) and decode(ids)."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("window size must be positive and above its overlap")

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = encoding()
        for texts in batches:
            yield texts.map(lambda t: [bpe.decode(list(w)) for w in _windows(bpe.encode(t), size, overlap)] if t else [])

    return _numbered(documents, cut(F.col("content")))
