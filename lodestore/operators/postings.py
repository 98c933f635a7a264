"""The inverted index: postings, term and corpus statistics, and BM25 search over them.

Postings are built once per corpus and read back; search never touches text. Statistics are corpus-wide and
independent of filters, which are tested after scoring.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.filters import compile_filter
from ..functions.scores import top_k
from ..sources.shared import written

Tokenizer = Callable[[Column], Column]


def build_postings(chunks: DataFrame, tokenizer: Tokenizer = tx.tokens) -> DataFrame:
    """(term, chunk_id, tf, dl): tf of each term of each chunk's index text, dl the number of its tokens."""
    words = tokenizer(tx.index_text(F.col("context"), F.col("content")))
    rows = chunks.select("chunk_id", words.alias("w")).select("chunk_id", F.size("w").alias("dl"), F.explode("w").alias("term"))
    return rows.groupBy("term", "chunk_id").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.max("dl").alias("dl"))


def corpus_stats(chunks: DataFrame, tokenizer: Tokenizer = tx.tokens) -> DataFrame:
    """One row (n, total, avgdl), chunks without a token included."""
    size = F.coalesce(F.size(tokenizer(tx.index_text(F.col("context"), F.col("content")))), F.lit(0))
    size = F.greatest(size, F.lit(0))
    return chunks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("total")).withColumn("avgdl", F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(0.0))


def index_stats(postings: DataFrame, chunks: DataFrame) -> tuple[int, float]:
    """(n, avgdl) of an index that is built: no text is read. n counts the chunks, with a token or without."""
    n = chunks.count()
    return n, float(postings.agg(F.sum("tf").alias("t")).first()["t"] or 0) / max(n, 1)


def term_stats(postings: DataFrame) -> DataFrame:
    """(term, df)."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(n: Column | float, df: Column) -> Column:
    n = F.lit(float(n)) if not isinstance(n, Column) else n
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def query_terms(searches: DataFrame, tokenizer: Tokenizer = tx.tokens) -> DataFrame:
    """(query_id, search_no, term, qtf): repeated terms of a search count repeatedly."""
    rows = searches.select("query_id", "search_no", F.explode(tokenizer(F.col("text"))).alias("term"))
    return rows.groupBy("query_id", "search_no", "term").agg(F.count(F.lit(1)).alias("qtf"))


def numbered(ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, no): distinct keys with numbers in their order, without a global sort: ranges are sorted apart."""
    rows = ids.select(key).where(F.col(key).isNotNull()).distinct()
    return rows.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("no", F.monotonically_increasing_id())


def _best_of_block(q: pd.DataFrame, x: pd.DataFrame, key: str, k: int, at_once: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, chunk, score) of the k best chunks of a block for each query.

    Scores add up in a table of `at_once` queries by the block's chunks, one outer product per term.
    """
    terms, code = np.unique(q["t"].to_numpy(np.int64), return_inverse=True)
    held = x["t"].to_numpy(np.int64)
    own = np.minimum(np.searchsorted(terms, held), len(terms) - 1)
    here = terms[own] == held
    own, x = own[here], x[here]
    values = x[key].to_numpy()
    keys, chunk = np.unique(values.astype(object) if values.dtype == object else values, return_inverse=True)
    order = np.argsort(own, kind="stable")
    part, chunk = x["part"].to_numpy(np.float64)[order], chunk[order]
    ends = np.searchsorted(own[order], np.arange(len(terms) + 1))
    asking = q["q"].to_numpy(np.int64)
    queries, row = np.unique(asking, return_inverse=True)
    weight = q["w"].to_numpy(np.float64)
    out = []
    for lo in range(0, len(queries), at_once):
        here = np.flatnonzero((row >= lo) & (row < lo + at_once))
        here = here[np.argsort(code[here], kind="stable")]
        table = np.zeros((min(at_once, len(queries) - lo), len(keys)))
        starts = np.flatnonzero(np.concatenate([[True], np.diff(code[here]) != 0])) if len(here) else []
        for s, e in zip(starts, [*starts[1:], len(here)]):
            t = code[here[s]]
            span = slice(ends[t], ends[t + 1])
            if span.start < span.stop:
                table[np.ix_(row[here[s:e]] - lo, chunk[span])] += np.outer(weight[here[s:e]], part[span])
        rank = np.rint(table * 1e9)
        least = np.partition(rank, len(keys) - k, axis=1)[:, len(keys) - k] if k < len(keys) else np.zeros(len(table))
        r, c = np.nonzero((rank >= least[:, None]) & (table > 0))
        best = np.lexsort((c, -rank[r, c], r))  # keys are sorted: the place of a chunk is its tie-break
        r, c = r[best], c[best]
        nth = np.arange(len(r)) - np.searchsorted(r, r)
        r, c = r[nth < k], c[nth < k]
        out.append((queries[r + lo], keys[c], table[r, c]))
    return tuple(np.concatenate(z) for z in zip(*out))


def search_sparse(searches: DataFrame, postings: DataFrame, n: int, avgdl: float, k: int, *, k1: float = 1.5, b: float = 0.75, tokenizer: Tokenizer = tx.tokens, chunks: DataFrame | None = None, where: dict | None = None, key: str = "chunk_id", block: int = 8_192, query_block: int = 20_000) -> DataFrame:
    """(query_id, search_no, key, sparse, rank): the k best chunks by BM25 of every search, in one plan.

    Weights are relational: the document frequency joins the terms asked for, never the text. Accumulating is not: a
    term that is in most chunks and most searches would make a row per pair of them. So postings are cut into blocks
    of chunks, searches into blocks of searches, and each pair of blocks is one bounded task that adds up in a table
    and returns its k best per search; what is shuffled is the postings of the terms asked for, and those few rows.
    A filter is tested after statistics and before scoring; the scores of what it leaves are the same. postings may
    hold a number in place of the chunk's id (`key`), in the ids' order (see numbered), which makes rows narrow.
    """
    columns = ["query_id", "search_no", key, "sparse", "rank"]
    kind = postings.schema[key].dataType.simpleString()
    if k <= 0 or n <= 0 or not avgdl:
        return searches.sparkSession.createDataFrame([], f"query_id {searches.schema['query_id'].dataType.simpleString()}, search_no int, {key} {kind}, sparse double, rank int")
    numbers = written(searches.select("query_id", "search_no").distinct().withColumn("q", F.monotonically_increasing_id()), "queries")
    asked = query_terms(searches, tokenizer)
    # The terms asked for that the index holds, numbered, with their weights: from here on no string of a term travels.
    weights = term_stats(postings.join(asked.select("term").distinct(), "term", "left_semi")).select("term", idf(float(n), F.col("df")).alias("idf"))
    weights = written(weights.withColumn("t", F.monotonically_increasing_id()), "terms")
    used = postings.join(weights.select("term", "t"), "term")
    if where and chunks is not None:
        used = used.join(chunks.where(compile_filter(where, F.col("meta"))).select(key), key, "left_semi")
    spread = searches.sparkSession.sparkContext.defaultParallelism
    xb = max(-(-n // block), min(spread, -(-n // 256)))
    qb = max(1, -(-numbers.count() // query_block))
    grid = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    tf = F.col("tf").cast("double")
    part = tf * F.lit(k1 + 1.0) / (tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / F.lit(float(avgdl))))
    right = used.select((F.col("t") + 0).alias("t"), key, part.alias("part"), F.pmod(F.xxhash64(key), F.lit(xb)).cast("int").alias("i"), grid(qb).alias("j"))
    left = asked.join(numbers, ["query_id", "search_no"]).join(weights, "term").select("q", (F.col("t") + 0).alias("t"), (F.col("qtf") * F.col("idf")).alias("w"), F.pmod(F.xxhash64("q"), F.lit(qb)).cast("int").alias("j"), grid(xb).alias("i"))

    def run(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"q": [], key: [], "sparse": []}, dtype=object)
        at, near, score = _best_of_block(q, x, key, k)
        return pd.DataFrame({"q": at, key: near, "sparse": score}, dtype=object)

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(run, f"q bigint, {key} {kind}, sparse double")
    return top_k(found, ["q"], k, "sparse", key).join(numbers, "q").select(*columns)


def terms_matched(searches: DataFrame, postings: DataFrame, tokenizer: Tokenizer = tx.tokens) -> DataFrame:
    """(query_id, search_no, matched): distinct terms of a search that the index holds."""
    asked = query_terms(searches, tokenizer).select("query_id", "search_no", "term")
    known = asked.join(postings.select("term").distinct().withColumn("known", F.lit(1)), "term", "left")
    return known.groupBy("query_id", "search_no").agg(F.count("known").alias("matched"))


def replace_postings(postings: DataFrame, changed: DataFrame, tokenizer: Tokenizer = tx.tokens) -> DataFrame:
    """Postings after chunks were added or changed: only those chunks are tokenised."""
    return drop_postings(postings, changed.select("chunk_id")).unionByName(build_postings(changed, tokenizer))


def drop_postings(postings: DataFrame, ids: DataFrame) -> DataFrame:
    return postings.join(ids.select("chunk_id").distinct(), "chunk_id", "left_anti")
