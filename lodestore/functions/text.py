"""Text columns: terms, normal form, trimming, byte cuts, token estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that is trimmed around texts: the Unicode White_Space characters, not the information separators.
SPACE = "\\t\\n\\x0B\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and decimal digits, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+"), lambda x: x != "")


def normalise(text: Column) -> Column:
    """White space collapsed, trimmed, lower-cased: the key under which texts are the same."""
    return F.lower(trim(F.regexp_replace(text, f"[{SPACE}]+", " ")))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+\\z", "")


def index_text(context: Column, content: Column) -> Column:
    """What is indexed of a chunk: its context, a blank line and its content; content alone without context."""
    has = context.isNotNull() & (context != "")
    return F.when(has, F.concat(context, F.lit("\n\n"), F.coalesce(content, F.lit("")))).otherwise(content)


def truncate_bytes(text: Column, size: int) -> Column:
    """At most size UTF-8 bytes, without a broken character at the end: of the bytes kept, those of an unfinished
    character are the trailing ones that do not decode."""
    raw = F.encode(text, "utf-8")

    def complete(n: int) -> Column:
        return F.try_validate_utf8(F.substring(raw, 1, n).cast("string"))

    cut = F.coalesce(*(complete(max(size - back, 0)) for back in range(4)), F.lit(""))
    return F.when(F.octet_length(text) <= size, text).otherwise(cut)


def token_estimate(text: Column, ratio: float = 4.0) -> Column:
    """Tokens by bytes: 0 for an empty text, else at least 1."""
    n = F.octet_length(text)
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / F.lit(ratio)))).cast("bigint")


def base_name(source: Column) -> Column:
    """File name without its folders and its extension."""
    return F.regexp_replace(F.regexp_replace(source, r"^.*[/\\]", ""), r"\.[^.]*\z", "")


def extension(source: Column) -> Column:
    return F.lower(F.regexp_extract(source, r"(\.[^./\\]*)\z", 1))


def without_thoughts(reply: Column) -> Column:
    """A model's reply without what stands between think tags; an unclosed tag stays as it is."""
    parts = F.split(reply, "(?i)<think>")
    end = lambda part: F.instr(F.lower(part), F.lit("</think>"))
    told = lambda part: F.when(end(part) > 0, F.substr(part, end(part) + len("</think>"))).otherwise(F.concat(F.lit("<think>"), part))
    return F.array_join(F.transform(parts, lambda part, i: F.when(i == 0, part).otherwise(told(part))), "")


def without_mark(line: Column) -> Column:
    """A line without its bullet or number: a first word that is no more than that goes."""
    words = F.split(trim(line), r"\s+", 2)
    first = words[0]
    mark = first.isin("-", "*", "•") | first.rlike("^[0-9]+[.)]$")
    return F.when((F.size(words) == 2) & mark, words[1]).otherwise(trim(line))


def cleaned_lines(reply: Column, most: int, exclude: Column) -> Column:
    """Up to `most` distinct lines of a model's reply, without reasoning, list marks, quotes, preambles and `exclude`."""
    one = lambda x: trim(F.btrim(trim(without_mark(x)), F.lit("\"'`“”*")))
    found = F.filter(F.transform(F.split(without_thoughts(reply), "\n"), one), lambda x: (x != "") & ~x.endswith(":") & (normalise(x) != normalise(exclude)))
    keys = F.transform(found, normalise)
    fresh = F.filter(found, lambda x, i: F.array_position(keys, normalise(x)) == i + 1)
    return F.slice(fresh, 1, most)
