"""The queries of the core over the driver's tables, and the same in SQL (plans.oracle)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as tx
from ..functions.filters import compile_filter
from ..functions.identity import chunk_id, document_id, uuid5
from ..functions.scores import min_max, ranked, sigmoid, top_k
from ..functions.vectors import hash_embedding
from ..operators import fusion, postings, prompt, rerank, rewrite
from ..operators.chunking import character_chunks, token_chunks
from ..operators.context import breadcrumb
from ..operators.dense import search_dense
from ..operators.expand import neighbours, windows
from ..sources import readers, tables
from ..sources.shared import fresh_path, written
from ..streaming.ingest import chunk_stream, into_store
from . import cache, evaluate, flow, oracle

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}
BLANK = r"[ \t\n\f\r]+"


def _query(f: Query) -> Query:
    _REGISTRY[f.__name__] = f
    return f


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _chunks(spark: SparkSession, d: str, columns: tuple[str, ...] = ("doc_id", "idx", "content", "context", "meta")) -> DataFrame:
    """The row of each chunk that counts; only the columns asked for are read and shuffled."""
    return tables.latest(_table(spark, d, "chunk").select("chunk_id", *columns, "ingested_at")).drop("ingested_at")


def _documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Documents, ingested twice or once; only the columns asked for are read and shuffled."""
    return tables.latest(_table(spark, d, "document").select("doc_id", *columns, "ingested_at"), "doc_id").drop("ingested_at")


def _searches(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "search_request").where("text IS NOT NULL")
    return rows.groupBy("query_id", "search_no").agg(F.min("text").alias("text"), F.min("target").alias("target"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """Ranked lists without repeats and without rows whose rank or score is unknown."""
    rows = _table(spark, d, "hit").where("rank IS NOT NULL AND score IS NOT NULL AND is_dense IS NOT NULL")
    one = rows.groupBy("query_id", "search_no", "is_dense", "chunk_id").agg(F.max("is_rewrite").alias("is_rewrite"), F.min("rank").alias("rank"), F.max(F.coalesce("dense", F.lit(0.0))).alias("dense"), F.max(F.coalesce("sparse", F.lit(0.0))).alias("sparse"), F.max("score").alias("score"))
    return one


def _reranked(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "hit").where("is_dense IS NULL AND rank IS NOT NULL AND score IS NOT NULL")
    return rows.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"), F.max("score").alias("score"))


def _r(c: str | Column) -> Column:
    return F.round(c, 6)


# ---- text, identity, index -----------------------------------------------------------------------------------------


@_query
def tokenize_terms(spark, d):
    rows = _table(spark, d, "documents").select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("term"))
    return rows.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


@_query
def token_estimates(spark, d):
    return _table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@_query
def truncated_texts(spark, d):
    return _table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", tx.truncate_bytes(F.col("text"), 100).alias("head"))


@_query
def doc_uuid5(spark, d):
    return _table(spark, d, "documents").where("text IS NOT NULL AND source IS NOT NULL").select("doc_id", document_id(F.col("source"), F.col("text")).alias("id"))


@_query
def chunk_uuid5(spark, d):
    return _chunks(spark, d, ("doc_id", "idx")).select("chunk_id", chunk_id(F.col("doc_id"), F.col("idx")).alias("id"))


@_query
def postings_tf(spark, d):
    return postings.build_postings(_chunks(spark, d, ("content", "context")))


@_query
def term_df(spark, d):
    return postings.term_stats(postings.build_postings(_chunks(spark, d, ("content", "context"))))


@_query
def corpus_stats(spark, d):
    return postings.corpus_stats(_chunks(spark, d, ("content", "context"))).select("n", "total", _r("avgdl").alias("avgdl"))


@_query
def hash_embed(spark, d):
    v = hash_embedding(tx.tokens(F.col("text")))
    return _table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.transform(v, lambda x: F.round(x, 6)).alias("embedding"))


# ---- search -------------------------------------------------------------------------------------------------------


def _index(chunks: DataFrame) -> tuple[DataFrame, DataFrame, int, float]:
    """(numbers, postings by number, n, avgdl): text is read and cut into terms once; numbers keep the ids' order."""
    numbers = written(postings.numbered(chunks), "numbers")
    held = written(postings.build_postings(chunks).join(numbers, "chunk_id").select("term", "no", "tf", "dl"), "postings")
    return numbers, held, *postings.index_stats(held, numbers)


def _search(numbers, index, n, avgdl, searches, k, **how) -> DataFrame:
    asked = searches.where("target IN ('all', 'sparse')").select("query_id", "search_no", "text")
    return postings.search_sparse(asked, index, n, avgdl, k, key="no", **how).join(numbers, "no").drop("no")


def _bm25(spark, d, where: dict | None = None, k: int = 10) -> DataFrame:
    numbers, index, n, avgdl = _index(_chunks(spark, d, ("content", "context")))
    tested = _chunks(spark, d, ("meta",)).join(numbers, "chunk_id") if where else None
    got = _search(numbers, index, n, avgdl, _searches(spark, d), k, chunks=tested, where=where)
    return got.select("query_id", "search_no", "chunk_id", _r("sparse").alias("score"), F.col("rank").cast("bigint").alias("rank"))


@_query
def bm25_topk(spark, d):
    return _bm25(spark, d)


@_query
def bm25_filtered(spark, d):
    return _bm25(spark, d, {"lang": "en"})


@_query
def bm25_terms_matched(spark, d):
    return postings.terms_matched(_searches(spark, d), postings.build_postings(_chunks(spark, d, ("content", "context"))))


def _vectors(spark, d) -> tuple[DataFrame, DataFrame]:
    """(queries, rows) of the embeddings table: every hundredth vector asks all of them."""
    rows = _table(spark, d, "embeddings")
    none = F.lit(None)
    label = F.create_map(F.lit("label"), F.struct(F.lit("int").alias("t"), none.cast("string").alias("s"), F.col("label").cast("double").alias("d"), none.cast("boolean").alias("b")))
    held = rows.select(F.format_string("%08d", "vec_id").alias("chunk_id"), "embedding", label.alias("meta"), "label")
    asked = rows.where("vec_id % 100 = 0").select(F.format_string("%08d", "vec_id").alias("query_id"), F.lit(0).alias("search_no"), F.col("embedding").alias("vector"))
    return asked, held


def _neighbours(spark, d, k=10, **how) -> DataFrame:
    asked, held = _vectors(spark, d)
    got = search_dense(asked, held, k, **how)
    return got.select(F.col("query_id").cast("bigint").alias("query"), F.col("chunk_id").cast("bigint").alias("vec_id"), _r("dense").alias("cosine"), F.col("rank").cast("bigint").alias("rank"))


@_query
def cosine_topk(spark, d):
    return _neighbours(spark, d)


@_query
def cosine_topk_filtered(spark, d):
    return _neighbours(spark, d, where={"label": {"$gte": 5}})


@_query
def cosine_floor(spark, d):
    return _neighbours(spark, d, floor=0.2)


@_query
def hybrid_retrieve(spark, d):
    """Dense (bag-of-words vectors) and sparse lists of every search, fused by weighted reciprocal rank, five per question."""
    chunks = _chunks(spark, d, ("content", "context"))
    numbers, index, n, avgdl = _index(chunks)
    searches = _searches(spark, d)
    words = tx.tokens(tx.index_text(F.col("context"), F.col("content")))
    held = chunks.withColumn("embedding", hash_embedding(F.coalesce(words, F.array().cast("array<string>"))))
    asked = searches.where("target IN ('all', 'dense')").withColumn("vector", hash_embedding(tx.tokens(F.col("text"))))
    dense = fusion.label(search_dense(asked, held, 50), True)
    sparse = fusion.label(_search(numbers, index, n, avgdl, searches, 50), False)
    fused = fusion.fuse_or_keep(dense.unionByName(sparse), fusion.rrf(60, 0.5), 5)
    return fused.select("query_id", "chunk_id", _r("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


# ---- filters ------------------------------------------------------------------------------------------------------

_FILTERS = {
    "filter_eq": {"lang": "en"},
    "filter_ne": {"lang": {"$ne": "en"}},
    "filter_in": {"lang": {"$in": ["de", "fr"]}},
    "filter_nin": {"lang": {"$nin": ["de", "fr"]}},
    "filter_any_of": {"lang": ["es", "ru"], "title": {"$ne": ""}},
    "filter_gt": {"version": {"$gt": 2}},
    "filter_gte": {"version": {"$gte": 2}},
    "filter_lt": {"version": {"$lt": 3}},
    "filter_lte": {"version": {"$lte": 3}},
}


def _filter_query(where: dict) -> Query:
    return lambda spark, d: _documents(spark, d, "meta").where(compile_filter(where, F.col("meta"))).select("doc_id")


_REGISTRY.update({name: _filter_query(where) for name, where in _FILTERS.items()})


# ---- fusion and scores --------------------------------------------------------------------------------------------


def _fused(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "chunk_id", _r("score").alias("score"), _r("dense").alias("dense"), _r("sparse").alias("sparse"), F.col("rank").cast("bigint").alias("rank"))


@_query
def rrf_fusion(spark, d):
    return _fused(fusion.rrf(60)(_hits(spark, d), 10))


@_query
def weighted_rrf(spark, d):
    return _fused(fusion.rrf(60, 0.5)(_hits(spark, d), 10))


@_query
def convex_blend(spark, d):
    return _fused(fusion.convex(0.6, 0.5)(_hits(spark, d), 10))


@_query
def fusion_bypass(spark, d):
    """Vector lists of the question alone: one list per query, kept as it is."""
    return _fused(fusion.fuse_or_keep(_hits(spark, d).where("is_dense AND search_no = 0"), fusion.rrf(60, 0.5), 5))


@_query
def minmax_norm(spark, d):
    return min_max(_hits(spark, d), ["query_id", "search_no", "is_dense"]).select("query_id", "search_no", "is_dense", "chunk_id", _r("score").alias("score"))


@_query
def sigmoid_norm(spark, d):
    return _hits(spark, d).select("query_id", "search_no", "is_dense", "chunk_id", _r(sigmoid(F.col("score"), 2.0)).alias("score"))


@_query
def dense_floor(spark, d):
    """Vector hits of at least 0.4, ranked again."""
    kept = _hits(spark, d).where("is_dense AND score >= 0.4").drop("rank")
    return ranked(kept, ["query_id", "search_no"]).select("query_id", "search_no", "chunk_id", F.col("rank").cast("bigint").alias("rank"))


# ---- rerank, expand, prompt ---------------------------------------------------------------------------------------


@_query
def mmr_top3(spark, d):
    asked, held = _vectors(spark, d)
    near = search_dense(asked, held, 10).withColumnRenamed("dense", "score")
    rows = near.join(held.select("chunk_id", "embedding"), "chunk_id").join(asked.select("query_id", "vector"), "query_id")
    got = rerank.mmr(rows.select("query_id", "rank", "chunk_id", "score", "vector", "embedding"), 3, 0.7)
    return got.select(F.col("query_id").cast("bigint").alias("query"), F.col("chunk_id").cast("bigint").alias("vec_id"), F.col("rank").cast("bigint").alias("rank"))


@_query
def overlap_rerank(spark, d):
    questions = _searches(spark, d).where("search_no = 0").select("query_id", F.col("text").alias("question"))
    rows = _reranked(spark, d).select("query_id", "chunk_id").join(_chunks(spark, d, ("content",)), "chunk_id").join(questions, "query_id")
    got = rerank.overlap(rows.withColumn("content", F.coalesce("content", F.lit(""))), 5)
    return got.select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


def _top_hits(spark, d, n: int) -> DataFrame:
    rows = _reranked(spark, d).where(F.col("rank") <= n)
    return rows.join(_chunks(spark, d, ("doc_id", "idx", "content")), "chunk_id").withColumn("content", F.coalesce("content", F.lit("")))


@_query
def neighbor_windows(spark, d):
    held = _chunks(spark, d, ("doc_id", "idx", "content")).withColumn("content", F.coalesce("content", F.lit("")))
    wide = windows(_top_hits(spark, d, 5), held, 1)
    return wide.select("query_id", F.col("rank").cast("bigint").alias("rank"), "chunk_id", F.size("parts").cast("bigint").alias("parts"), F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("content"))


@_query
def neighbors_expand(spark, d):
    held = _chunks(spark, d, ("doc_id", "idx", "content")).withColumn("content", F.coalesce("content", F.lit("")))
    return neighbours(_top_hits(spark, d, 5), held, 1).select("query_id", F.col("rank").cast("bigint").alias("rank"), "chunk_id", "content")


@_query
def context_budget(spark, d):
    chosen = prompt.choose_passages(_top_hits(spark, d, 10), 500)
    return chosen.select("query_id", F.col("place").cast("bigint").alias("place"), "chunk_id")


@_query
def lost_in_middle(spark, d):
    rows = _reranked(spark, d)
    n = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    placed = ranked(rows.select("query_id", "chunk_id", (-F.col("rank")).cast("double").alias("score")), ["query_id"]).join(n, "query_id")
    return placed.select("query_id", "chunk_id", (prompt.middle_position(F.col("rank") - 1, F.col("n")) + 1).cast("bigint").alias("place"))


@_query
def history_budget(spark, d):
    """The searches of a query as turns of a conversation, the newest that fit."""
    turn = F.struct("search_no", F.col("target").alias("role"), F.col("text").alias("content"))
    turns = _searches(spark, d).groupBy("query_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return turns.select("query_id", prompt.history_text(F.col("turns"), 35).alias("history"))


@_query
def prompt_tokens(spark, d):
    questions = _searches(spark, d).where("search_no = 0").select("query_id", "text")
    rows = _top_hits(spark, d, 5).groupBy("query_id").agg(F.collect_list("content").alias("contents")).join(questions, "query_id")
    return rows.select("query_id", prompt.prompt_tokens(F.col("text"), F.col("contents")).alias("tokens"))


@_query
def prompts(spark, d):
    questions = _searches(spark, d).where("search_no = 0").select("query_id", F.col("text").alias("question"))
    made = prompt.build_prompts(questions.join(_reranked(spark, d).select("query_id").distinct(), "query_id", "left_semi"), _top_hits(spark, d, 10), 1024)
    return made.select("query_id", F.octet_length("prompt").cast("bigint").alias("bytes"), F.size("sources").cast("bigint").alias("sources"))


# ---- sources, chunkers, context -----------------------------------------------------------------------------------


@_query
def read_files(spark, d):
    """Contents of documents as files, read by the extension of their source; what cannot be read says why."""
    files = _documents(spark, d, "source", "content").where("source IS NOT NULL AND content IS NOT NULL").select(F.col("source").alias("path"), F.octet_length("content").cast("bigint").alias("length"), F.encode("content", "utf-8").alias("content"))
    return readers.read_files(files).select("source", "seq", "section", "title", "content", "error")


@_query
def token_window_chunks(spark, d):
    rows = _table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("content"))
    made = token_chunks(rows, 64, 16, lambda c: F.filter(F.split(c, BLANK), lambda x: x != ""))
    return made.select("doc_id", F.col("idx").cast("bigint").alias("idx"), "content", "chunk_id")


@_query
def char_chunks(spark, d):
    rows = _documents(spark, d, "content").where("content IS NOT NULL").select("doc_id", "content")
    return character_chunks(rows, 800, 100).select("doc_id", "idx", "content", "chunk_id")


@_query
def breadcrumbs(spark, d):
    return _documents(spark, d, "meta").where("meta IS NOT NULL").select("doc_id", breadcrumb(F.col("meta")).alias("context"))


# ---- tables, cache, workflow, evaluation --------------------------------------------------------------------------

SOURCE = "handbook/field-guide.md"


@_query
def upsert_chunks(spark, d):
    """Chunks written up to June 2025, then the rest over them."""
    rows = _table(spark, d, "chunk").select("chunk_id", "doc_id", "idx", "content", "ingested_at")
    early = F.coalesce(F.col("ingested_at") < F.lit("2025-06-01").cast("timestamp_ntz"), F.lit(True))
    both = tables.upsert(tables.latest(rows.where(early)), tables.latest(rows.where(~early)))
    return both.select("chunk_id", "doc_id", F.col("idx").cast("bigint").alias("idx"), "content")


@_query
def delete_source(spark, d):
    return tables.delete_source(_chunks(spark, d, ("meta",)), SOURCE).select("chunk_id")


@_query
def replace_source(spark, d):
    held = _chunks(spark, d, ("idx", "meta"))
    new = held.where((tables.source_of(F.col("meta")) == SOURCE) & (F.col("idx") == 0))
    return tables.replace_source(held, SOURCE, new).select("chunk_id", F.col("idx").cast("bigint").alias("idx"))


@_query
def delete_ids(spark, d):
    """Everything that no list holds is left when listed chunks are deleted."""
    return tables.delete(_chunks(spark, d, ("doc_id",)), _table(spark, d, "hit").select("chunk_id")).select("chunk_id")


@_query
def stream_ingest(spark, d):
    """The chunk table as a stream into a versioned store."""
    schema = StructType(spark.read.parquet(f"{d}/chunk.parquet").schema.fields)
    root = fresh_path(spark, "stream")
    store = tables.Store(spark, f"{root}/store")
    into_store(chunk_stream(spark, f"{d}/chunk.parque[t]", schema), store, f"{root}/checkpoint").awaitTermination()
    return store.chunks().select("chunk_id", "doc_id", F.col("idx").cast("bigint").alias("idx"))


@_query
def search_dedup(spark, d):
    one = F.struct("search_no", "text", "target")
    rows = _searches(spark, d).groupBy("query_id").agg(F.sort_array(F.collect_list(one)).alias("s"))
    kept = rewrite.deduplicate(F.transform("s", lambda x: F.struct(x["text"].alias("text"), x["target"].alias("target"))))
    return rows.select("query_id", F.posexplode(kept).alias("n", "s")).select("query_id", F.col("n").cast("bigint").alias("n"), "s.text", "s.target")


@_query
def cache_exact(spark, d):
    """How often each key was asked: equal questions of one target share an answer."""
    key = cache.cache_key(F.col("target"), F.col("text"))
    return _searches(spark, d).where("target IS NOT NULL").groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("asked"))


@_query
def cache_semantic(spark, d):
    """The nearest other vector of the same label, if it is near enough."""
    asked, held = _vectors(spark, d)
    labelled = asked.join(held.select(F.col("chunk_id").alias("query_id"), "label"), "query_id")
    near = search_dense(labelled, held, 2, floor=0.15, within="label").where("chunk_id <> query_id")  # two, as one may be the vector itself
    best = top_k(near.drop("rank"), ["query_id"], 1, "dense")
    return best.select(F.col("query_id").cast("bigint").alias("query"), F.col("chunk_id").cast("bigint").alias("vec_id"), _r("dense").alias("cosine"))


@_query
def cache_evict(spark, d):
    """The twenty newest questions per target."""
    rows = _searches(spark, d).where("target IS NOT NULL").select(uuid5(F.encode(F.concat_ws("/", "query_id", "search_no"), "utf-8")).alias("key"), F.col("target").alias("scope"), F.struct("query_id", "search_no").alias("seq"), F.lit(None).cast("timestamp").alias("expires"), "query_id", "search_no")
    return cache.kept(rows, 20).select("query_id", "search_no", "scope")


@_query
def evidence_pool(spark, d):
    hits = _hits(spark, d).where("is_dense").select("query_id", (F.col("search_no") + 1).alias("hop"), "rank", "chunk_id")
    return flow.pool_evidence(hits).select("query_id", F.col("place").cast("bigint").alias("place"), "chunk_id")


@_query
def crag_route(spark, d):
    """Where each query goes after grading by its best reranker score: answer, refine by its first rewrite, abstain."""
    searches = _searches(spark, d)
    state = searches.groupBy("query_id").agg(F.max(F.when(F.col("search_no") == 0, F.col("text"))).alias("question"), F.max(F.when(F.col("search_no") == 1, F.col("text"))).alias("missing"), F.count(F.lit(1)).alias("hops"))
    best = _reranked(spark, d).groupBy("query_id").agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("evidence"))
    rows = state.join(best, "query_id", "left").withColumn("evidence", F.coalesce("evidence", F.lit(0)))
    verdict = F.when(F.coalesce("best", F.lit(-1.0)) > 0, flow.SUFFICIENT).otherwise(flow.INSUFFICIENT)
    repeated = F.coalesce(tx.normalise(F.col("missing")) == tx.normalise(F.col("question")), F.lit(False))
    return rows.select("query_id", flow.route_column(verdict, F.col("evidence"), F.col("hops"), F.col("missing"), repeated, 3).alias("route"))


def _cases(spark, d) -> tuple[DataFrame, DataFrame]:
    """Expected: the sources of a query's three best reranked chunks; found: its vector list. Category: its target."""
    source = _chunks(spark, d, ("meta",)).select("chunk_id", tables.source_of(F.col("meta")).alias("source"))
    wanted = _reranked(spark, d).where("rank <= 3").join(source.where("source IS NOT NULL"), "chunk_id").groupBy("query_id").agg(F.sort_array(F.collect_set("source")).alias("wants"))
    kind = _searches(spark, d).where("search_no = 0").select("query_id", F.coalesce("target", F.lit("none")).alias("category"))
    cases = wanted.join(kind, "query_id").select(F.col("query_id").alias("case_id"), "category", "wants")
    hits = _hits(spark, d).where("is_dense AND search_no = 0").join(source, "chunk_id").select(F.col("query_id").alias("case_id"), "rank", F.lit("").alias("content"), "source")
    return cases, hits


@_query
def eval_cases(spark, d):
    cases, hits = _cases(spark, d)
    s = evaluate.case_scores(evaluate.first_ranks(cases, hits, 10, "source"), 10)
    return s.select("case_id", "category", "hit", *(_r(c).alias(c) for c in ("recall", "rr", "ndcg")))


@_query
def eval_metrics(spark, d):
    cases, hits = _cases(spark, d)
    got = evaluate.evaluate(cases, hits, 10, "source")
    return got.select(F.coalesce("category", F.lit("total")).alias("category"), "cases", *(_r(c).alias(c) for c in ("hit_rate", "recall", "mrr", "ndcg")))


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def oracle_sql() -> dict[str, str]:
    return oracle.statements(SOURCE)
