"""Splitting oversized items at natural boundaries: content-defined chunking.

A rolling hash over the bytes marks landmarks that depend only on the bytes around them. From the start of a piece
the first landmark between the minimum and the maximum size is taken and snapped to the nearest natural boundary of
the coarsest kind there is in reach (blank line, line, white space, character); so an edit moves only the cuts near
it. Consecutive pieces share `overlap_bytes`, moved forward to the start of a character. Which kind of boundary alone
suffices is told by the same cutter, confined to one kind without overlap: it gets through or it meets a stretch that
no boundary of that kind cuts in time.

Defined results
* Sizes are UTF-8 bytes. A piece is measured without surrounding blanks, tabs and newlines; a piece that holds
  nothing else is left out, but an item of blanks alone keeps one empty piece. Pieces are numbered from 0; the overlap counts towards the limit.
* Any overlap from 0 to below the limit is kept as asked (null: 0); a negative one or one at the limit or above is an error.
* Items within the limit are not split and do not come out. Null contents are not items.
* Rows repeated under one id count once: the longest content, then the greatest in string order.
* boundary is the coarsest kind that alone gives pieces within the limit: paragraph, line, word or none.
* Records without a limit row do not come out. Empty tables give an empty result; other columns are not read.
* Texts are whole: of any length, in time linear in it.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = ("paragraph", "line", "word", "none")
_CUTS = (re.compile(r"\n[^\S\n]*\n\s*"), re.compile(r"\n\s*"), re.compile(r"\s+"))
_EDGE = " \t\r\n"
_WINDOW = 24


def landmarks(data: np.ndarray, spacing: int) -> np.ndarray:
    """Offsets after which the hash of the last _WINDOW bytes is 0 modulo spacing, found for all offsets at once."""
    n = len(data)
    if n < _WINDOW:
        return np.zeros(0, np.int64)
    h = np.zeros(n - _WINDOW + 1, np.uint64)
    factor = np.uint64(1)
    x = data.astype(np.uint64) + np.uint64(1)
    for j in range(_WINDOW):
        h += x[_WINDOW - 1 - j : n - j] * factor
        factor = np.uint64((int(factor) * 0x9E3779B97F4A7C15) & (2**64 - 1))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.flatnonzero((h >> np.uint64(33)) % np.uint64(spacing) == 0) + _WINDOW


class Text:
    """A text's bytes, its landmarks, and for each kind of boundary where pieces may stop and where the next begins."""

    def __init__(self, text: str):
        self.raw = text.encode()
        self.data = np.frombuffer(self.raw, np.uint8)
        self.starts = np.flatnonzero((self.data & 0xC0) != 0x80)  # the first byte of each character
        n = len(self.raw)
        place = np.append(self.starts, n)
        edges = np.isin(self.data, np.frombuffer(_EDGE.encode(), np.uint8))
        solid = np.flatnonzero(~edges)
        #: For every offset, where the text before it ends, and where the text after it begins, but for blanks.
        self.before = np.zeros(n + 1, np.int64)
        self.before[solid + 1] = solid + 1
        self.before = np.maximum.accumulate(self.before)
        self.after = np.full(n + 1, n, np.int64)
        self.after[solid] = solid
        self.after = np.minimum.accumulate(self.after[::-1])[::-1]
        #: Per kind, in order: where the next piece begins, and where the piece before it stops.
        self.kinds: list[tuple[np.ndarray, np.ndarray]] = []
        for cut in _CUTS:
            spans = np.fromiter((x for m in cut.finditer(text) for x in m.span()), np.int64).reshape(-1, 2)
            stop, at = self.before[place[spans[:, 0]]], place[spans[:, 1]]
            self.kinds.append((np.append(at[at < n], n), np.append(stop[at < n], self.before[n])))
        at = np.append(self.starts, n)
        self.kinds.append((at, self.before[at]))

    def cuts(self, limit: int, overlap: int, kinds: list[tuple[np.ndarray, np.ndarray]], whole: bool = True) -> list[tuple[int, int, int]] | None:
        """(head, start, stop) of all pieces, cut at the given kinds of boundary; from head to start is the overlap.

        None if no boundary is in reach and whole is not asked; else such a character stays whole.
        """
        n, out, start = len(self.raw), [], 0
        fresh = limit - overlap
        marks = landmarks(self.data, max(8, fresh // 2))
        while start < n:
            head = start
            if start:
                k = np.searchsorted(self.starts, start - overlap)
                head = int(self.starts[k]) if k < len(self.starts) else start
            begin = int(self.after[head])
            room = begin + limit  # what is measured begins after blanks
            if self.before[n] <= room:
                stop = cut = n
            else:
                low = start + max(1, (limit - start + head) // 4)
                k = np.searchsorted(marks, low)
                goal = int(marks[k]) if k < len(marks) and marks[k] <= room else room
                found = self._cut(kinds, start, low, room, goal)
                if found is None:
                    if not whole:
                        return None
                    nxt = np.searchsorted(self.starts, start, "right")  # a limit below one character
                    cut = stop = int(self.starts[nxt]) if nxt < len(self.starts) else n
                else:
                    cut, stop = found
            out.append((head, start, stop))
            start = cut
        return out

    @staticmethod
    def _cut(kinds: list[tuple[np.ndarray, np.ndarray]], start: int, low: int, room: int, goal: int) -> tuple[int, int] | None:
        """The boundary nearest to goal of the first kind that has one from low to room, else of the first that has one at all."""
        for floor in (low, start + 1):
            for at, stop in kinds:
                i, j = np.searchsorted(at, floor), np.searchsorted(stop, room, "right")
                if i < j:
                    k = np.searchsorted(at[i:j], goal) + i
                    best = min((q for q in (k - 1, k) if i <= q < j), key=lambda q: (abs(int(at[q]) - goal), -q))
                    return int(at[best]), int(stop[best])
        return None

    def piece(self, head: int, stop: int) -> str:
        return self.raw[head:stop].decode().strip(_EDGE)


def coarsest_boundary(text: Text, limit: int) -> str:
    """The coarsest kind of boundary with which alone the cutter gets through."""
    return next((level for level, at in zip(LEVELS[:-1], text.kinds) if text.cuts(limit, 0, [at], whole=False) is not None), "none")


def pieces(text: str | Text, limit: int, overlap: int) -> list[str]:
    if not 0 <= overlap < limit:
        raise ValueError(f"an overlap of {overlap} bytes does not go with a limit of {limit}")
    held = Text(text) if isinstance(text, str) else text
    if len(held.raw) <= limit:
        return [held.raw.decode()]
    got = [held.piece(head, stop) for head, start, stop in held.cuts(limit, overlap, held.kinds) if held.after[start] < stop]
    return got or [""]


def split_oversized(items: DataFrame, limits: DataFrame) -> DataFrame:
    """(record, item_id, boundary, idx, piece) for items(record, item_id, content) above their record's limit.

    The limit table has one row per kind of record and a fixed size. The size test runs in the JVM, so only
    oversized items are de-duplicated, shuffled and handed to Python.
    """
    rules = limits.where(F.col("record").isNotNull()).groupBy("record").agg(F.min("max_bytes").alias("max_bytes"), F.max("overlap_bytes").alias("overlap_bytes"))
    big = items.where(F.col("item_id").isNotNull() & F.col("content").isNotNull()).join(F.broadcast(rules), "record").where(F.octet_length("content") > F.col("max_bytes"))
    one = big.groupBy("record", "item_id").agg(F.max(F.struct(F.octet_length("content").alias("n"), "content", "max_bytes", "overlap_bytes")).alias("m"))
    one = one.select("record", "item_id", "m.content", "m.max_bytes", F.coalesce("m.overlap_bytes", F.lit(0)).alias("overlap_bytes"))

    def cut(batches):
        for pdf in batches:
            out = []
            for record, item, text, limit, overlap in pdf.itertuples(index=False):
                held = Text(text)
                level = coarsest_boundary(held, limit)
                out += [(record, item, level, k, p) for k, p in enumerate(pieces(held, limit, overlap))]
            yield pd.DataFrame(out, columns=["record", "item_id", "boundary", "idx", "piece"])

    return one.mapInPandas(cut, "record string, item_id string, boundary string, idx int, piece string")


def boundaries(split: DataFrame) -> DataFrame:
    """(record, item_id, boundary), once per item: each item has a piece 0."""
    return split.where("idx = 0").select("record", "item_id", "boundary")


def two_tables(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    a = documents.select(F.lit("document").alias("record"), F.col("doc_id").alias("item_id"), "content")
    return a.unionByName(chunks.select(F.lit("chunk").alias("record"), F.col("chunk_id").alias("item_id"), "content"))
