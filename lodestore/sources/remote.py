"""Remote vector databases as sinks and search sides: Chroma (v2) and Qdrant.

Both keep content, document id, index and metadata, not the context. upsert_partitions writes from the executors in
batches; search, get and deletes are single calls from the driver. The in-memory filter semantics are canonical; what
a server understands differently is said in functions.filters.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from ..errors import EmptySource
from ..functions.filters import to_chroma, to_qdrant
from .http import Client, Transport, send

_OWN = ("document_id", "chunk_index")


def _plain(meta: dict | None) -> dict:
    """Metadata values as JSON scalars."""
    out = {}
    for key, v in (meta or {}).items():
        v = v.asDict() if hasattr(v, "asDict") else v
        if isinstance(v, dict) and "t" in v:
            v = {"str": v["s"], "json": v["s"], "bool": v["b"], "float": v["d"], "int": None if v["d"] is None else int(v["d"])}[v["t"]]
        if v is not None:
            out[key] = v
    return out


def _batches(rows, size: int):
    batch = []
    for row in rows:
        if row["chunk_id"]:
            batch.append(row)
        if len(batch) == size:
            yield batch
            batch = []
    if batch:
        yield batch


class _Sink:
    batch = 256

    def upsert_partitions(self, chunks: DataFrame) -> None:
        """Writes chunks(chunk_id, doc_id, idx, content, embedding, meta) from where they are."""
        chunks.select("chunk_id", "doc_id", "idx", "content", "embedding", "meta").foreachPartition(self._write)

    def _write(self, rows) -> None:
        for batch in _batches(rows, self.batch):
            self.upsert(batch)


@dataclass
class ChromaStore(_Sink):
    url: str
    collection: str
    tenant: str = "default_tenant"
    database: str = "default_database"
    transport: Transport = send
    _id: str = field(default="", repr=False)

    def _root(self) -> str:
        return f"/api/v2/tenants/{self.tenant}/databases/{self.database}/collections"

    def _client(self) -> Client:
        return Client(self.url, transport=self.transport)

    def _at(self, what: str) -> str:
        if not self._id:
            got = self._client().json("POST", self._root(), {"name": self.collection, "get_or_create": True, "metadata": {"hnsw:space": "cosine"}})
            self._id = got["id"]
        return f"{self._root()}/{self._id}/{what}"

    def upsert(self, chunks) -> None:
        metas = [_plain(c["meta"]) | {"document_id": c["doc_id"], "chunk_index": c["idx"]} for c in chunks]
        self._client().json("POST", self._at("upsert"), {"ids": [c["chunk_id"] for c in chunks], "embeddings": [list(map(float, c["embedding"])) for c in chunks], "documents": [c["content"] for c in chunks], "metadatas": metas})

    def delete(self, ids: list[str]) -> None:
        if ids:
            self._client().json("POST", self._at("delete"), {"ids": ids})

    def search(self, vector: list[float], k: int, where: dict | None = None) -> list[dict]:
        if k <= 0:
            return []
        body = {"query_embeddings": [list(map(float, vector))], "n_results": k, "include": ["documents", "metadatas", "distances"]}
        if (w := to_chroma(where)) is not None:
            body["where"] = w
        got = self._client().json("POST", self._at("query"), body)
        return [self._row(i, d, m) | {"dense": 1.0 - dist} for i, d, m, dist in zip(got["ids"][0], got["documents"][0], got["metadatas"][0], got["distances"][0])]

    def get(self, ids: list[str]) -> list[dict]:
        if not ids:
            return []
        got = self._client().json("POST", self._at("get"), {"ids": ids, "include": ["documents", "metadatas"]})
        held = {i: self._row(i, d, m) for i, d, m in zip(got["ids"], got["documents"], got["metadatas"])}
        return [held[i] for i in ids if i in held]

    def delete_source(self, source: str, keep: list[str] = ()) -> None:
        if not source:
            raise EmptySource()
        got = self._client().json("POST", self._at("get"), {"where": {"source": {"$eq": source}}, "include": []})
        self.delete([i for i in got["ids"] if i not in set(keep)])

    @staticmethod
    def _row(i: str, content: str, meta: dict | None) -> dict:
        meta = dict(meta or {})
        return {"chunk_id": i, "content": content or "", "doc_id": meta.pop("document_id", ""), "idx": int(meta.pop("chunk_index", 0)), "meta": meta}


@dataclass
class QdrantStore(_Sink):
    url: str
    collection: str
    dimension: int
    transport: Transport = send
    _made: bool = field(default=False, repr=False)

    def _client(self) -> Client:
        return Client(self.url, transport=self.transport)

    def _at(self, what: str) -> str:
        root = f"/collections/{self.collection}"
        if not self._made:
            self._client().json("PUT", root, {"vectors": {"size": self.dimension, "distance": "Cosine"}}, accept=(409,))
            self._made = True
        return root + what

    @staticmethod
    def _uuid(i: str) -> bool:
        try:
            return str(uuid.UUID(i)) == i.lower()
        except (ValueError, AttributeError):
            return False

    def upsert(self, chunks) -> None:
        points = [{"id": c["chunk_id"], "vector": list(map(float, c["embedding"])), "payload": {"content": c["content"], "document_id": c["doc_id"], "chunk_index": c["idx"], "metadata": _plain(c["meta"])}} for c in chunks if self._uuid(c["chunk_id"])]
        if points:
            self._client().json("PUT", self._at("/points?wait=true"), {"points": points})

    def delete(self, ids: list[str]) -> None:
        if good := [i for i in ids if self._uuid(i)]:
            self._client().json("POST", self._at("/points/delete?wait=true"), {"points": good})

    def search(self, vector: list[float], k: int, where: dict | None = None) -> list[dict]:
        if k <= 0:
            return []
        body = {"query": list(map(float, vector)), "limit": k, "with_payload": True}
        if (w := to_qdrant(where)) is not None:
            body["filter"] = w
        got = self._client().json("POST", self._at("/points/query"), body)
        return [self._row(p) | {"dense": p["score"]} for p in got["result"]["points"]]

    def get(self, ids: list[str]) -> list[dict]:
        good = [i for i in ids if self._uuid(i)]
        if not good:
            return []
        got = self._client().json("POST", self._at("/points"), {"ids": good, "with_payload": True})
        held = {p["id"]: self._row(p) for p in got["result"]}
        return [held[i] for i in ids if i in held]

    def delete_source(self, source: str, keep: list[str] = ()) -> None:
        if not source:
            raise EmptySource()
        rule = {"must": [{"key": "metadata.source", "match": {"value": source}}]}
        if good := [i for i in keep if self._uuid(i)]:
            rule["must_not"] = [{"has_id": good}]
        self._client().json("POST", self._at("/points/delete?wait=true"), {"filter": rule})

    @staticmethod
    def _row(p: dict) -> dict:
        load = p.get("payload") or {}
        return {"chunk_id": p["id"], "content": load.get("content", ""), "doc_id": load.get("document_id", ""), "idx": int(load.get("chunk_index", 0)), "meta": load.get("metadata") or {}}


def search_remote(searches: DataFrame, store, k: int, where: dict | None = None, floor: float = 0.0) -> DataFrame:
    """(query_id, search_no, chunk_id, dense, rank) for searches(query_id, search_no, vector), asked of a remote store.

    One request per search, from the tasks that hold the searches; floor > 0 drops weaker hits before ranks are given.
    """
    kind = searches.schema["query_id"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            out = []
            for q, s, v in zip(pdf["query_id"], pdf["search_no"], pdf["vector"]):
                hits = [h for h in store.search(list(v), k, where) if floor <= 0 or h["dense"] >= floor] if v is not None else []
                out += [(q, s, h["chunk_id"], float(h["dense"]), i) for i, h in enumerate(hits[:k], 1)]
            yield pd.DataFrame(out, columns=["query_id", "search_no", "chunk_id", "dense", "rank"])

    return searches.select("query_id", "search_no", "vector").mapInPandas(run, f"query_id {kind}, search_no int, chunk_id string, dense double, rank int")
