"""What the operators of this folder share: tables, the shared folder of the core, normalised words."""

from __future__ import annotations

import re

import regex
from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import shared_folder, written

_ASCII_WORD = re.compile(r"[a-z0-9]+")
_WORD = regex.compile(r"[\p{L}\p{Nd}]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str) -> list[str]:
    """Lower-cased runs of letters and digits."""
    low = text.lower()
    return _ASCII_WORD.findall(low) if low.isascii() else _WORD.findall(low)


__all__ = ["shared_folder", "table", "words", "written"]
