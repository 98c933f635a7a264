"""Ingest and retrieval. A batch of questions is one plan; a single question is a batch of one row."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Cancelled, EmptyQuery, EmptySource, MissingChunker, MissingEmbedder, MissingGenerator, MissingStore, NoChunks, NoResults
from ..functions import text as tx
from ..functions.identity import section_id
from ..operators import fusion as fuse
from ..operators import prompt as pr
from ..operators import rewrite as rw
from ..operators.chunking import character_chunks
from ..operators.context import metadata_context
from ..operators.dense import search_dense
from ..operators.embedding import Embedder, embed_chunks, embed_searches
from ..operators.postings import index_stats, search_sparse
from ..operators.rerank import cut
from ..sources.shared import written
from ..sources.readers import read_files, with_meta
from ..sources.remote import search_remote
from ..sources.tables import Store
from .observe import METRICS, Tracer, stage


@dataclass
class Answer:
    question: str
    text: str = ""
    sources: list = field(default_factory=list)
    retrieved: list = field(default_factory=list)
    searches: list = field(default_factory=list)
    rewrite_error: str | None = None
    dense_error: str | None = None


@dataclass
class Engine:
    """Numbers that are not positive stand for their defaults, as in every option here; transform_timeout (seconds per model call) then means no limit.

    vector_store: a remote store (sources.remote) that is searched by vector in place of the store's own chunks. It gets
    the chunks before they are published, so that a failure there publishes nothing; texts and postings stay in the store.
    """

    store: Store
    embedder: Embedder | None = None
    vector_store: Any = None
    use_dense: bool = True
    use_sparse: bool = True
    chunker: Callable[[DataFrame], DataFrame] | None = None
    contextualizer: Callable[[DataFrame], DataFrame] = metadata_context
    readers: dict | None = None
    max_bytes: int = 0
    rewriter: rw.Rewriter | None = None
    fusion: fuse.Fusion | None = None
    reranker: Callable[[DataFrame, int], DataFrame] | None = None
    expander: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    generator: Any = None
    replace_source: bool = False
    min_dense_score: float = 0.0
    dense_fail_open: bool = False
    recall: int = 50
    top_n: int = 5
    rrf_k: int = 60
    embed_batch: int = 32
    embed_workers: int = 8
    max_tokens: int = 4096
    system: str = ""
    transform_timeout: float = 0.0
    k1: float = 1.5
    b: float = 0.75
    tracer: Tracer | None = None

    def __post_init__(self):
        for name, default in (("recall", 50), ("top_n", 5), ("rrf_k", 60), ("embed_batch", 32), ("embed_workers", 8)):
            if getattr(self, name) <= 0:
                setattr(self, name, default)
        if not (self.use_dense or self.use_sparse):
            raise MissingStore()
        if self.use_dense and self.embedder is None:
            raise MissingEmbedder()
        if self.fusion is None:
            self.fusion = fuse.rrf(self.rrf_k, 0.5)

    @property
    def spark(self) -> SparkSession:
        return self.store.spark

    # ---- ingest ---------------------------------------------------------------------------------------------------

    def documents(self, files: DataFrame, meta: dict | None = None) -> DataFrame:
        """documents(doc_id, source, seq, content, meta) of files; ids come from the given source, not the file's own."""
        read = read_files(files, self.max_bytes, self.readers, strict=True)
        rows = with_meta(read, meta)
        section = F.coalesce(F.element_at("meta", "section")["s"], F.lit(""))
        return rows.withColumn("doc_id", section_id(F.col("source"), section, F.col("content")))

    def chunks(self, documents: DataFrame) -> DataFrame:
        if self.chunker is None:
            raise MissingChunker()
        made = self.contextualizer(self.chunker(documents))
        if self.use_dense:
            made = embed_chunks(made, self.embedder, self.embed_batch, self.embed_workers)
        else:
            made = made.withColumn("embedding", F.lit(None).cast("array<float>"))
        return made.select("chunk_id", "doc_id", "idx", "content", "context", "embedding", "meta")

    def ingest(self, source: str, data: bytes, meta: dict | None = None) -> int:
        """One source by name. A failure before publishing leaves the store as it was."""
        if not source:
            raise EmptySource()
        files = self.spark.createDataFrame([(source, len(data), bytearray(data))], "path string, length bigint, content binary")
        return self.ingest_files(files, meta, source if self.replace_source else None)

    def ingest_files(self, files: DataFrame, meta: dict | None = None, replace: str | None = None) -> int:
        with stage("ingest", self.spark, tracer=self.tracer):
            made = written(self.chunks(self.documents(files, meta)), "ingest")  # models are asked once
            n = made.count()
            if not n:
                raise NoChunks()
            if self.vector_store is not None:
                if replace:
                    self.vector_store.delete_source(replace, [r["chunk_id"] for r in made.select("chunk_id").toLocalIterator()])
                self.vector_store.upsert_partitions(made.where(F.col("embedding").isNotNull()))
            if replace:
                self.store.replace_source(replace, made)
            else:
                self.store.upsert(made)
            METRICS.count("chunks_ingested", n)
            return n

    def delete_source(self, source: str) -> None:
        if self.vector_store is not None:
            self.vector_store.delete_source(source)
        self.store.delete_source(source)

    # ---- retrieval ------------------------------------------------------------------------------------------------

    def searches(self, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Questions with their rewrites, and the numbered searches."""
        rows = rw.prepared(questions)
        if self.rewriter is not None:
            with rw.time_limit(self.transform_timeout):
                rows = self.rewriter(rows)
        return rows, rw.search_rows(rows)

    def hits(self, searches: DataFrame, where: dict | None = None, recall: int = 0) -> DataFrame:
        """Ranked lists of all searches over all the indexes they ask for."""
        recall = recall if recall > 0 else self.recall
        chunks = self.store.chunks()
        lists = []
        if self.use_dense:
            vectors = embed_searches(searches, self.embedder, self.embed_batch, self.embed_workers)
            if self.vector_store is not None:
                found = search_remote(vectors, self.vector_store, recall, where, self.min_dense_score)
            else:
                found = search_dense(vectors, chunks, recall, where=where, floor=self.min_dense_score)
            lists.append(fuse.label(found, True))
        if self.use_sparse:
            index = self.store.postings()
            n, avgdl = index_stats(index, chunks)
            wanted = searches.where(F.col("target").isin("all", "sparse"))
            lists.append(fuse.label(search_sparse(wanted, index, n, avgdl, recall, k1=self.k1, b=self.b, chunks=chunks, where=where), False))
        out = lists[0]
        for other in lists[1:]:
            out = out.unionByName(other)
        return out

    def retrieve_batch(self, questions: DataFrame, where: dict | None = None, recall: int = 0, top_n: int = 0) -> DataFrame:
        """(query_id, rank, chunk_id, doc_id, idx, score, dense, sparse, content, context, meta) for questions(query_id, question[, history])."""
        recall = recall if recall > 0 else self.recall
        top_n = top_n if top_n > 0 else self.top_n
        if self.store.chunks() is None:
            return self.spark.createDataFrame([], "query_id string, rank int, chunk_id string, doc_id string, idx int, score double, dense double, sparse double, content string, context string, meta map<string,struct<t:string,s:string,d:double,b:boolean>>")
        rows, searches = self.searches(questions)
        fused = fuse.fuse_or_keep(self.hits(searches, where, recall), self.fusion, recall)
        held = self.store.chunks()
        if self.reranker is not None:
            text = fused.join(held.select("chunk_id", "content", "context", "embedding"), "chunk_id").join(rows.select("query_id", rw.current().alias("question")), "query_id")
            text = text.withColumn("index_text", tx.index_text(F.col("context"), F.col("content")))
            best = self.reranker(text, top_n).select("query_id", "chunk_id", "rank", "score")
            fused = best.join(fused.select("query_id", "chunk_id", "dense", "sparse"), ["query_id", "chunk_id"])
        else:
            fused = cut(fused, top_n)
        # Contents join the few rows that are left, not the candidates.
        out = fused.join(held.select("chunk_id", "doc_id", "idx", "content", "context", "meta"), "chunk_id")
        if self.expander is not None:
            wide = self.expander(out.select("query_id", "rank", "chunk_id", "doc_id", "idx", "score", "content"), held)
            out = wide.join(out.select("query_id", "chunk_id", "dense", "sparse", "context", "meta"), ["query_id", "chunk_id"])
        return out.select("query_id", "rank", "chunk_id", "doc_id", "idx", "score", "dense", "sparse", "content", "context", "meta")

    def retrieve(self, question: str, *, where: dict | None = None, history: list[tuple[str, str]] = (), recall: int = 0, top_n: int = 0, cancelled: Callable[[], bool] = lambda: False) -> Answer:
        if not question or not question.strip():
            raise EmptyQuery()
        if cancelled():
            raise Cancelled()
        turns = [{"role": r, "content": c} for r, c in history]
        asked = self.spark.createDataFrame([("q", question, turns)], "query_id string, question string, history array<struct<role:string,content:string>>")
        answer = Answer(question)
        rows, searches = self.searches(asked)
        if self.rewriter is not None:
            kept = rows.select("question", "rewritten", "searches", "rewrite_error").first()
            answer.question, answer.rewrite_error = kept["rewritten"] or question, kept["rewrite_error"]
            rows = asked.withColumn("rewritten", F.lit(kept["rewritten"]).cast("string")).withColumn("searches", F.from_json(F.lit(_json(kept["searches"])), rw.SEARCHES)).withColumn("rewrite_error", F.lit(None).cast("string"))
            searches = rw.search_rows(rows)
        answer.searches = [(s["text"], s["target"]) for s in searches.orderBy("search_no").collect()]
        engine = self
        with stage("retrieve", self.spark, tracer=self.tracer, recall=recall or self.recall, top_n=top_n or self.top_n):
            try:
                got = self._settled(rows).retrieve_batch(rows, where, recall, top_n).orderBy("rank").collect()
            except Exception as error:
                if cancelled() or not (self.dense_fail_open and self.use_dense and self.use_sparse):
                    raise
                answer.dense_error = f"{type(error).__name__}: {str(error)[:4000]}"
                engine = self._with(use_dense=False)
                got = engine._settled(rows).retrieve_batch(rows, where, recall, top_n).orderBy("rank").collect()
        METRICS.count("queries")
        if not got:
            nothing = NoResults()
            nothing.answer = answer  # workflows go on with the question as rewritten and its searches
            raise nothing
        answer.retrieved = got
        return answer

    def _with(self, **changes) -> Engine:
        import dataclasses

        return dataclasses.replace(self, **changes)

    def _settled(self, rows: DataFrame) -> Engine:
        """This engine for questions whose rewrites are already columns: models are not asked again."""
        return self._with(rewriter=None)

    # ---- answers --------------------------------------------------------------------------------------------------

    def prompts(self, questions: DataFrame, hits: DataFrame) -> DataFrame:
        return pr.build_prompts(questions, hits, self.max_tokens, self.system)

    def prompt_for(self, question: str, history, hits: list) -> tuple[Any, dict]:
        """(prompt and ids of its sources, hits by id) of one question; hits are taken in the order they have."""
        asked = self.spark.createDataFrame([("q", question, [{"role": r, "content": c} for r, c in history])], "query_id string, question string, history array<struct<role:string,content:string>>")
        rows = self.spark.createDataFrame([("q", i, h["chunk_id"], h["content"]) for i, h in enumerate(hits, 1)], "query_id string, rank int, chunk_id string, content string")
        return self.prompts(asked, rows).first(), {h["chunk_id"]: h for h in hits}

    def query_iter(self, question: str, **options) -> tuple[Answer, Iterator[str]]:
        """Retrieval at once; tokens as they are asked for. The answer's text grows with them."""
        if not question or not question.strip():
            raise EmptyQuery()
        if self.generator is None:
            raise MissingGenerator()
        answer = self.retrieve(question, **options)
        made, by_id = self.prompt_for(answer.question, options.get("history", ()), answer.retrieved)
        answer.sources = [by_id[i] for i in made["sources"]]

        def tokens() -> Iterator[str]:
            for t in self.generator.tokens(made["prompt"]):
                answer.text += t
                yield t

        return answer, tokens()

    def query(self, question: str, **options) -> Answer:
        answer, tokens = self.query_iter(question, **options)
        for _ in tokens:
            pass
        return answer

    def query_stream(self, question: str, callback: Callable[[str], None], **options) -> Answer:
        if callback is None:
            raise ValueError("query_stream needs a callback")
        answer, tokens = self.query_iter(question, **options)
        for t in tokens:
            callback(t)
        return answer


def _json(searches) -> str:
    import json

    return json.dumps([{"text": s["text"], "target": s["target"]} for s in searches or []])


def default_chunker(size: int = 800, overlap: int = 0) -> Callable[[DataFrame], DataFrame]:
    return lambda documents: character_chunks(documents, size, overlap)

