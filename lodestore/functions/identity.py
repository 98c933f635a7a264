"""Stable ids: version 5 UUIDs in the URL namespace, computed inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: the URL namespace of RFC 4122.
_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """The UUID of binary `name`: SHA-1 over namespace and name, with version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(_NAMESPACE)), name))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def document_id(source: Column, content: Column) -> Column:
    return uuid5(F.concat(F.encode(source, "utf-8"), F.unhex(F.lit("00")), F.encode(content, "utf-8")))


def section_id(source: Column, section: Column, content: Column) -> Column:
    """Id of a section: its path is part of the key, unless it is empty."""
    key = F.concat(F.encode(section, "utf-8"), F.unhex(F.lit("00")), F.encode(content, "utf-8"))
    plain = F.encode(content, "utf-8")
    return uuid5(F.concat(F.encode(source, "utf-8"), F.unhex(F.lit("00")), F.when(F.coalesce(section, F.lit("")) != "", key).otherwise(plain)))


def chunk_id(doc_id: Column, idx: Column) -> Column:
    return uuid5(F.encode(F.concat(doc_id, F.lit("#"), idx.cast("string")), "utf-8"))
