"""Keyword-stuffed and link-list pages: recurrence gaps, positional autocorrelation, lists without function words.

A page is a sequence of terms (words, characters of scripts without blanks, and one term for every link). Sentences show
in the gaps between function words: in running text one follows another within a few terms, in lists of keywords, tags,
names or links none does. Which words these are is learnt from the whole corpus: words that many texts of a language
have and that stand in sentences, hardly ever in what is no sentence. Three things take a stretch of terms out of the text
that flows:

* no function word within `gap` terms: a list of nouns, tags, names or links;
* a term, no function word or number, that comes back at gaps of at most `close` terms, `runs` times on end;
* a lag within the lag window at which half of a window's terms come back (positional autocorrelation).

A page whose flowing text is less than half of it (`most`), by characters, is stuffed, unless it is code or numbers.

Defined results
* Null, empty and blank texts are not flagged. A page of fewer than `least` terms is flagged only if at least four
  terms are there and repetition or links fill half of it, so a bare word is none.
* In a script of which the corpus has taught no function words, sentences are told by their end marks, and only
  repetition or links that fill half of a page flag it.
* Null ids are left out; of rows repeated under one id, one flagged row is enough. Other columns are not read.
* Copies of a text count once in what is learnt. An empty corpus teaches nothing and gives an empty result.
* Texts are whole; the work is that of sorting a page's terms.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

_LINK = re.compile(r"(?:https?://|www\.)[^\s<>\"'()\[\]]+", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<\|\w+\|>|\[(?:CLS|SEP|PAD|UNK|MASK)\]")
_UNSPACED = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿"
#: A link, a character of a script without blanks, a word, an end of a sentence, an end of a line.
_TERM = re.compile(rf"(?:https?://|www\.)[^\s<>\"'()\[\]]+|[{_UNSPACED}]|[^\W_{_UNSPACED}]+(?:['’][^\W_]+)?|[.!?…]+(?!\w)|[。！？।۔؟]|\n")
_CODE = re.compile(r"[{}]|\w\(|:=|[+*/-]=|&&|\|\||(?<!\w)--\w|\*\*\s*\d|\w\[\w+\]|^\s*(?:for|if|while|return|let|var|const|def|class|import|SELECT|curl|print|func|fn|#include)\b|\s==?\s|^\s*==|^\s*(?:#|//) \w|\s\|\s*\w+ -\w")
_LAGS = 64
_END_MARK, _NEW_LINE, _LINK_TERM, _NUMBER, _WORD = range(5)


@dataclass(frozen=True)
class Limits:
    """gap, close, runs: see above. share, odds: from where a word is a function word (see function_words)."""

    most: float = 0.5
    gap: int = 10
    close: int = 4
    runs: int = 3
    least: int = 8
    code: float = 0.5
    letters: float = 0.4
    share: float = 0.05
    odds: float = 100.0


def script(word: str) -> str:
    """The script of a word's first character, as Unicode names it."""
    return unicodedata.name(word[0], "?").split()[0]


class _Codes(dict):
    """Terms to numbers, with what is known of each in arrays; forgets all when it holds too many."""

    def __init__(self, known: frozenset[str] = frozenset(), most: int = 500_000):
        super().__init__()
        self.known, self.most, self.scripts = known, most, frozenset(script(w) for w in known)
        self.terms: list[str] = []
        self.kind, self.width = np.zeros(4096, np.int8), np.zeros(4096, np.int32)
        self.function, self.taught = np.zeros(4096, bool), np.zeros(4096, bool)

    def __missing__(self, term: str) -> int:
        if term == "\n":
            kind = _NEW_LINE
        elif term.startswith(("http:", "https:", "www.")):
            kind = _LINK_TERM
            if "\0" in self:
                return self["\0"]  # all links are one term
        elif term[0] in ".!?…。！？।۔؟":
            kind = _END_MARK
        else:
            kind = _NUMBER if any(x.isdigit() for x in term) else _WORD
        code = len(self.terms)
        self["\0" if kind == _LINK_TERM else term] = code
        self.terms.append(term)
        if code == len(self.kind):
            for name in ("kind", "width", "function", "taught"):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros_like(getattr(self, name))]))
        self.kind[code], self.width[code] = kind, len(term)
        self.function[code], self.taught[code] = term in self.known, kind == _WORD and script(term) in self.scripts
        return code

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(codes, lengths) of all terms, end marks and line ends of a text."""
        if len(self) > self.most:
            self.__init__(self.known, self.most)
        if "<" in text or "[" in text:
            text = _TAG.sub(lambda m: " " + " ".join(_LINK.findall(m[0])) + " ", text)
        got = _TERM.findall(text.lower())
        at = np.fromiter(map(self.__getitem__, got), np.int64, len(got))
        width = self.width[at]
        if "\0" in self:
            links = np.flatnonzero(at == self["\0"])
            width[links] = [len(got[i]) for i in links]
        return at, width


def _units(kind: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit of each term, whether each unit is a sentence): closed by an end mark on its line, three words at least."""
    cut = kind <= _NEW_LINE
    unit = np.cumsum(cut) - cut
    n = int(unit[-1]) + 1 if len(unit) else 0
    closed = np.zeros(n, bool)
    closed[unit[cut]] = kind[cut] == _END_MARK
    return unit, closed & (np.bincount(unit[word], minlength=n) >= 3)


def function_words(documents: DataFrame, text_col: str = "text", lang_col: str | None = None, limits: Limits = Limits()) -> frozenset[str]:
    """Words that at least `share` of a language's texts have (by the lower bound of a Wilson interval of three deviations)
    and that stand in sentences `odds` times as often as outside on pages that are not mostly sentences, counted over all texts.

    A text with many copies counts once: each copy has its part (a text of less than a ten-thousandth of the rows is
    let off, so at most 10,000 counts of copies are broadcast). A language is the first two letters of lang_col, right or wrong: only a word's commonness is told by it, and a word
    found in one language counts in all. Texts without one are a group of their own. What reaches the driver is bounded:
    a language has at most (mean number of distinct words of a text) / share such words, and two letters name at most 677 groups.
    """

    def count(batches):
        codes = _Codes()
        texts: dict[str, float] = {}
        table: dict[tuple[str, int], list[float]] = {}

        def flush():
            rows = [(g, codes.terms[c], *v) for (g, c), v in table.items()] + [(g, "", n, 0.0, 0.0) for g, n in texts.items()]
            table.clear()
            texts.clear()
            return pd.DataFrame(rows, columns=["lang", "term", "df", "inside", "outside"])

        for pdf in batches:
            for lang, text, part in zip(pdf["l"], pdf["t"], pdf["part"]):
                if len(codes) > 400_000:  # numbers of terms are kept until their counts are sent
                    yield flush()
                    codes = _Codes()
                at, _ = codes.read(text)
                if not len(at):
                    continue
                kind = codes.kind[at]
                word = kind == _WORD
                unit, sentence = _units(kind, word)
                texts[lang] = texts.get(lang, 0.0) + part
                c, w = np.unique(at[word], return_inverse=True)
                inside = np.bincount(w, weights=sentence[unit[word]], minlength=len(c))
                listing = 2 * inside.sum() < len(w)  # titles of pages of sentences are no lists
                total = np.bincount(w, minlength=len(c)) if listing else inside
                for code, i, o in zip(c.tolist(), (part * inside).tolist(), (part * (total - inside)).tolist()):
                    v = table.get((lang, code))
                    if v is None:
                        table[lang, code] = [part, i, o]
                    else:
                        v[0] += part
                        v[1] += i
                        v[2] += o
            if len(table) > 500_000:
                yield flush()
        yield flush()

    lang = F.regexp_extract(F.lower(F.trim(F.coalesce(F.col(lang_col).cast("string"), F.lit("")))), "^[a-z]{2}", 0) if lang_col else F.lit("")
    rows = documents.where(F.trim(F.coalesce(F.col(text_col), F.lit(""))) != "").select(lang.alias("l"), F.col(text_col).cast("string").alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t"))
    copies = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(2, rows.count() // 10_000))
    rows = rows.join(F.broadcast(copies), "h", "left").select("l", "t", (F.lit(1.0) / F.coalesce("n", F.lit(1))).alias("part"))
    counted = rows.mapInPandas(count, "lang string, term string, df double, inside double, outside double").groupBy("term", "lang").agg(*(F.sum(c).alias(c) for c in ("df", "inside", "outside")))
    counted = written(counted, "words")
    texts = {r["lang"]: round(r["df"]) for r in counted.where("term = ''").collect()}
    if not texts:
        return frozenset()
    bound = F.create_map(*(F.lit(x) for g, n in texts.items() for x in (g, _least(n, limits.share))))
    able = counted.where((F.col("term") != "") & (F.col("df") > bound[F.col("lang")] - 1e-6))
    odds = counted.groupBy("term").agg(F.sum("inside").alias("s"), F.sum("outside").alias("o")).where(F.col("s") >= F.lit(limits.odds) * F.col("o"))
    return frozenset(r["term"] for r in able.select("term").distinct().join(odds.select("term"), "term").collect())


def _least(n: int, share: float, z: float = 3.0) -> int:
    """The least count of n, three at least, whose Wilson lower bound reaches share; n + 1 if none does."""

    def low(k: int) -> float:
        p = k / n
        return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)

    lo, hi = min(3, n + 1), n + 1
    while lo < hi:
        mid = (lo + hi) // 2
        if low(mid) >= share:
            hi = mid
        else:
            lo = mid + 1
    return lo


def regular(codes: np.ndarray, free: np.ndarray, limits: Limits) -> np.ndarray:
    """Which terms stand in unnaturally regular repetition; terms marked free (function words, numbers) never start it."""
    n = len(codes)
    out = np.zeros(n, bool)
    if n < 4:
        return out
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    gap = np.zeros(n, np.int64)  # to the last place of the same term, 0: none
    gap[order[1:]] = np.where(ranked[1:] == ranked[:-1], order[1:] - order[:-1], 0)
    gap[free] = 0
    counts = np.bincount(np.minimum(gap, _LAGS + 1), minlength=_LAGS + 2)
    mark = np.zeros(n + 1, np.int64)
    # a term at close gaps, several times on end
    if counts[1 : limits.close + 1].sum() >= limits.runs:
        near = gap[order]
        close = np.concatenate([[False], (near > 0) & (near <= limits.close), [False]])
        edge = np.flatnonzero(close[1:] != close[:-1])
        starts, ends = edge[::2], edge[1::2]
        long = ends - starts >= limits.runs
        mark += np.bincount(order[starts[long] - 1], minlength=n + 1) - np.bincount(order[ends[long] - 1] + 1, minlength=n + 1)
    # a lag at which half of a window comes back
    lags = np.arange(1, _LAGS + 1)
    for lag in lags[2 * counts[1 : _LAGS + 1] >= np.minimum(n, np.maximum(2 * lags, 16))]:
        size = min(n, max(2 * int(lag), 16))
        sums = np.concatenate([[0], np.cumsum(gap == lag)])
        full = np.flatnonzero(2 * (sums[size:] - sums[:-size]) >= size)
        mark += np.bincount(np.maximum(full - lag, 0), minlength=n + 1) - np.bincount(full + size, minlength=n + 1)
    return np.cumsum(mark[:n]) > 0


def flowing(function: np.ndarray, gap: int) -> np.ndarray:
    """Which terms stand between function words that follow one another within `gap` terms."""
    n = len(function)
    ends = np.concatenate([[-1], np.flatnonzero(function), [n]])
    if len(ends) == 2:
        return np.zeros(n, bool)
    near = ends[1:] - ends[:-1] <= gap
    mark = np.bincount(np.maximum(ends[:-1][near], 0), minlength=n + 1) - np.bincount(np.minimum(ends[1:][near] + 1, n), minlength=n + 1)
    return np.cumsum(mark[:n]) > 0


@dataclass
class Reader:
    """Judges pages by the function words it is given."""

    known: frozenset[str]
    limits: Limits = Limits()
    codes: _Codes = field(init=False)

    def __post_init__(self):
        self.codes = _Codes(self.known)

    def __call__(self, text: str | None) -> tuple[bool, float, float]:
        """(stuffed, share of the page that flows, share in regular repetition)."""
        limits = self.limits
        if not text or not text.strip():
            return False, 0.0, 0.0
        at, size = self.codes.read(text)
        kind = self.codes.kind[at]
        term = kind >= _LINK_TERM
        own, width, what = at[term], size[term], kind[term]
        n, word = len(own), what == _WORD
        if not n:
            return False, 0.0, 0.0
        free = self.codes.function[own]
        total = float(width.sum())
        linked = float(width[what == _LINK_TERM].sum()) / total
        taught = not word.any() or 2 * self.codes.taught[own].sum() > word.sum()
        if taught:
            flow = flowing(free, limits.gap)
        else:
            unit, sentence = _units(kind, kind == _WORD)
            flow = sentence[unit[term]]
        again = regular(own, free | (what == _NUMBER), limits)
        share = float(width[flow & ~again].sum()) / total
        repeated = float(width[again].sum()) / total
        if share >= limits.most:
            return False, share, repeated
        lines = [x for x in text.splitlines() if x.strip()]
        if sum(bool(_CODE.search(_LINK.sub("", x))) for x in lines) >= limits.code * len(lines) or linked < limits.most and word.mean() < limits.letters:
            return False, share, repeated
        if n < limits.least or not taught:
            return n >= 4 and max(repeated, linked) >= limits.most, share, repeated
        return True, share, repeated


def stuffed_pages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None, limits: Limits = Limits(), known: frozenset[str] | None = None) -> DataFrame:
    """(id, stuffed, flow, repeated): one pass that counts words, one narrow stage that judges pages.

    Of the first only counts per word and language travel, added up on the map side; no text is shuffled.
    """
    if known is None:
        known = function_words(documents, text_col, lang_col, limits)
    shared = documents.sparkSession.sparkContext.broadcast(known)  # bounded, see function_words

    def run(batches):
        judge = Reader(shared.value, limits)
        for pdf in batches:
            if len(pdf):
                got = [judge(t) for t in pdf["t"]]
                yield pd.DataFrame({id_col: pdf["i"].to_numpy(dtype=object), "stuffed": [g[0] for g in got], "flow": [g[1] for g in got], "repeated": [g[2] for g in got]})

    rows = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInPandas(run, f"`{id_col}` bigint, stuffed boolean, flow double, repeated double")


def flagged(pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return pages.where("stuffed").select(id_col).distinct()
