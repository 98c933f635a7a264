import json

import pytest

from lodestore.errors import CountMismatch, EmptySource
from lodestore.sources import models, remote
from lodestore.sources.http import HttpError, Response

CHUNK = {"chunk_id": "5f0c4b1e-8a5f-5d7c-9f0a-0a4b1e8a5f5d", "doc_id": "d", "idx": 3, "content": "text", "embedding": [0.5, 1.0], "meta": {"lang": {"t": "str", "s": "en", "d": None, "b": None}, "n": {"t": "int", "s": None, "d": 4.0, "b": None}}}


class Server:
    """Answers by (method, end of the path); keeps what it was asked."""

    def __init__(self, **answers):
        self.answers, self.asked = answers, []

    def __call__(self, request):
        body = json.loads(request.body) if request.body else None
        self.asked.append((request.method, request.url, body, request.headers))
        for end, answer in self.answers.items():
            if request.url.split("?")[0].endswith(end):
                status, value = answer if isinstance(answer, tuple) else (200, answer)
                lines = value if isinstance(value, list) and value and isinstance(value[0], bytes) else [json.dumps(value).encode()]
                return Response(status, iter(lines))
        return Response(200, iter([b"{}"]))


def test_chroma():
    s = Server(collections={"id": "ID"}, query={"ids": [["a"]], "documents": [["t"]], "metadatas": [[{"document_id": "d", "chunk_index": 2, "lang": "en"}]], "distances": [[0.25]]}, get={"ids": ["b", "a"], "documents": ["B", "A"], "metadatas": [None, None]})
    store = remote.ChromaStore("http://h", "c", transport=s)
    store.upsert([CHUNK])
    method, url, body, _ = s.asked[1]
    assert url == "http://h/api/v2/tenants/default_tenant/databases/default_database/collections/ID/upsert"
    assert body["metadatas"] == [{"lang": "en", "n": 4, "document_id": "d", "chunk_index": 3}]
    assert store.search([1.0, 0.0], 3, {"lang": "en"}) == [{"chunk_id": "a", "content": "t", "doc_id": "d", "idx": 2, "meta": {"lang": "en"}, "dense": 0.75}]
    assert s.asked[-1][2]["where"] == {"lang": {"$eq": "en"}}
    assert [r["chunk_id"] for r in store.get(["a", "no", "b"])] == ["a", "b"]
    store.delete_source("src", keep=["a"])
    assert s.asked[-1][2] == {"ids": ["b"]}
    assert store.search([1.0], 0) == []
    with pytest.raises(EmptySource):
        store.delete_source("")
    assert sum(u.endswith("/collections") for _, u, _, _ in s.asked) == 1


def test_qdrant():
    point = {"id": CHUNK["chunk_id"], "score": 0.9, "payload": {"content": "text", "document_id": "d", "chunk_index": 3, "metadata": {"lang": "en"}}}
    s = Server(**{"/collections/c": (409, {}), "/points/query": {"result": {"points": [point]}}, "/points": {"result": [point]}})
    store = remote.QdrantStore("http://h", "c", 2, transport=s)
    store.upsert([CHUNK, CHUNK | {"chunk_id": "no-uuid"}])
    assert len(s.asked[-1][2]["points"]) == 1
    assert s.asked[-1][2]["points"][0]["payload"]["metadata"] == {"lang": "en", "n": 4}
    assert store.search([1.0, 0.0], 1, {"lang": {"$ne": "de"}})[0]["dense"] == 0.9
    assert s.asked[-1][2]["filter"] == {"must_not": [{"key": "metadata.lang", "match": {"value": "de"}}]}
    assert store.get([CHUNK["chunk_id"], "x"])[0]["idx"] == 3
    store.delete_source("src", keep=[CHUNK["chunk_id"]])
    assert s.asked[-1][2]["filter"]["must_not"] == [{"has_id": [CHUNK["chunk_id"]]}]


def test_upsert_from_executors(spark, tmp_path):
    rows = spark.createDataFrame([(f"i{n}", "d", n, "t", [1.0], None) for n in range(5)], "chunk_id string, doc_id string, idx int, content string, embedding array<float>, meta map<string,struct<t:string,s:string,d:double,b:boolean>>")

    class Sink(remote._Sink):
        batch = 2

        def __init__(self, folder):
            self.folder = folder

        def upsert(self, chunks):
            import os
            import uuid

            with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as f:
                f.write(",".join(c["chunk_id"] for c in chunks))

    Sink(str(tmp_path)).upsert_partitions(rows.coalesce(1))
    wrote = [p.read_text().split(",") for p in tmp_path.iterdir()]
    assert sorted(map(len, wrote)) == [1, 2, 2]
    assert sorted(i for w in wrote for i in w) == [f"i{n}" for n in range(5)]


def test_embedders():
    s = Server(embeddings={"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]})
    assert models.OpenAIEmbedder("k", transport=s).embed(["a", "b"]) == [[1.0], [2.0]]
    assert s.asked[0][3]["Authorization"] == "Bearer k"
    with pytest.raises(CountMismatch):
        models.OpenAIEmbedder("k", transport=s).embed(["a"])
    e = models.OllamaEmbedder(transport=Server(embed={"embeddings": [[1.0, 2.0, 3.0]]}))
    assert e.embed(["a"]) == [[1.0, 2.0, 3.0]]
    assert e.dimension == 3
    with pytest.raises(HttpError) as error:
        models.OllamaEmbedder(transport=Server(embed=(503, {}))).embed(["a"])
    assert error.value.temporary


def test_rerankers():
    s = Server(rerank={"results": [{"index": 1, "relevance_score": 0.9}, {"index": 0, "relevance_score": 0.1}, {"index": 7, "relevance_score": 1.0}]})
    assert models.HttpReranker("http://h", transport=s).score("q", ["a", "b"]) == [0.1, 0.9]
    assert s.asked[0][2]["top_n"] == 2
    tei = Server(rerank=[{"index": 0, "score": 0.3}])
    got = models.HttpReranker("http://h", models.instructed("m", "find"), "tei", transport=tei).score("q", ["a"])
    assert got == [0.3]
    assert tei.asked[0][2]["query"].startswith("<Instruct>: find")
    assert models.CohereReranker("k", transport=s).score("q", ["a", "b"]) == [0.1, 0.9]


def test_generators():
    lines = [b'data: {"choices":[{"delta":{"content":"He"}}]}\n', b"\n", b'data: {"choices":[{"delta":{"content":"y"}}]}\n', b"data: [DONE]\n"]
    s = Server(completions=(200, lines))
    assert list(models.OpenAIGenerator("k", transport=s).tokens("p", "sys")) == ["He", "y"]
    assert s.asked[0][2]["messages"] == [{"role": "user", "content": "sys\n\np"}]
    assert models.OpenAIGenerator("k", transport=s)("pre", "fix") == "Hey"
    chat = Server(chat=(200, [b'{"message":{"content":"a"}}\n', b'{"message":{"content":"b"},"done":true}\n']))
    assert list(models.OllamaGenerator("m", num_ctx=9, transport=chat).tokens("p")) == ["a", "b"]
    assert chat.asked[0][2]["options"] == {"num_ctx": 9}
    assert chat.asked[0][2]["think"] is False
    with pytest.raises(RuntimeError, match="boom"):
        list(models.OllamaGenerator("m", transport=Server(chat=(200, [b'{"error":"boom"}\n']))).tokens("p"))
