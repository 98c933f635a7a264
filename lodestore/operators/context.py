"""Chunk context: what a chunk's document and section say about it."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


class Completer(Protocol):
    """One-shot text completion; prefix is the part that is shared by many calls."""

    def __call__(self, prefix: str, prompt: str) -> str: ...


def meta_text(meta: Column, key: str) -> Column:
    return F.coalesce(F.element_at(meta, key)["s"], F.lit(""))


def breadcrumb(meta: Column) -> Column:
    """'title > section'; the file name without extension stands in for a missing title."""
    title = meta_text(meta, "title")
    title = F.when(title != "", title).otherwise(tx.base_name(meta_text(meta, "source")))
    section = meta_text(meta, "section")
    return F.when(title == "", section).when(section == "", title).otherwise(F.concat(title, F.lit(" > "), section))


def metadata_context(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("context", F.coalesce(breadcrumb(F.col("meta")), F.lit("")))


def window(document: str, piece: str, size: int, share: float) -> str:
    """About size bytes of the document around the piece, or around its share of the way if it is not found."""
    raw = document.encode()
    if len(raw) <= size:
        return document
    body = piece.encode()
    at = raw.find(body)
    middle = at + len(body) // 2 if at >= 0 else int(share * len(raw))
    lo = min(max(0, middle - size // 2), len(raw) - size)
    return raw[lo : lo + size].decode(errors="ignore")


def model_context(chunks: DataFrame, documents: DataFrame, completer: Completer, *, size: int = 8000, workers: int = 4, instruction: str = "Give a short sentence that situates this passage within the document. Output only the sentence.") -> DataFrame:
    """The breadcrumb and a sentence of a model about each chunk.

    Chunks of one document are answered together, the first alone, so that a provider can keep the shared prefix.
    A document that fits the window is the prefix of its chunks; else each chunk gets a window of it.
    """
    rows = metadata_context(chunks).join(documents.select("doc_id", F.col("content").alias("_whole")), "doc_id")
    names = [c for c in rows.columns if c != "_whole"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", ignore_index=True)
        whole = pdf["_whole"].iloc[0] or ""
        fits = len(whole.encode()) <= size

        def ask(i: int) -> str:
            piece = pdf["content"].iloc[i] or ""
            seen = whole if fits else window(whole, piece, size, i / max(1, len(pdf)))
            head = f"<document>\n{seen}\n</document>\n"
            task = f"<passage>\n{piece}\n</passage>\n{instruction}"
            return completer(head, task) if fits else completer("", head + task)

        said = [ask(0)]
        with ThreadPoolExecutor(max(1, workers)) as pool:
            said += pool.map(ask, range(1, len(pdf)))
        pdf["context"] = ["\n".join(x for x in (c, s.strip()) if x) for c, s in zip(pdf["context"], said)]
        return pdf[names]

    return rows.groupBy("doc_id").applyInPandas(run, rows.drop("_whole").schema)


Contextualizer = Callable[[DataFrame], DataFrame]
