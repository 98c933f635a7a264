"""HTTP models: embedders, rerankers and generators. All of them take an injectable transport."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from ..errors import CountMismatch, EmptyEmbeddings
from .http import Client, Transport, send


@dataclass
class OpenAIEmbedder:
    key: str
    model: str = "text-embedding-3-small"
    endpoint: str = "https://api.openai.com/v1/embeddings"
    dimension: int = 1536
    transport: Transport = send

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        got = Client(self.endpoint, self.key, self.transport).json("POST", "", {"model": self.model, "input": texts})["data"]
        if len(got) != len(texts):
            raise CountMismatch(f"{len(got)} of {len(texts)}")
        out: list = [None] * len(texts)
        for d in got:  # answers carry their place
            if not 0 <= d["index"] < len(out):
                raise CountMismatch(f"index {d['index']}")
            out[d["index"]] = d["embedding"]
        return out


@dataclass
class OllamaEmbedder:
    model: str = "nomic-embed-text"
    endpoint: str = "http://localhost:11434"
    dimension: int = 768
    transport: Transport = send

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        got = Client(self.endpoint, transport=self.transport).json("POST", "/api/embed", {"model": self.model, "input": texts})["embeddings"]
        if len(got) != len(texts):
            raise CountMismatch(f"{len(got)} of {len(texts)}")
        if not got[0]:
            raise EmptyEmbeddings()
        self.dimension = len(got[0])
        return got


@dataclass(frozen=True)
class Model:
    """A cross-encoder: its name, and how it wants questions and passages wrapped."""

    name: str = "BAAI/bge-reranker-v2-m3"
    question: str = "{}"
    passage: str = "{}"
    limit: int = 0

    def wrap(self, question: str, passages: list[str]) -> tuple[str, list[str]]:
        cut = lambda t: t if not self.limit else t.encode()[: self.limit].decode(errors="ignore")
        return self.question.replace("{}", question), [self.passage.replace("{}", cut(p)) for p in passages]


def instructed(name: str, instruction: str) -> Model:
    """A model that reads an instruction before question and passage."""
    return Model(name, f"<Instruct>: {instruction}\n<Query>: {{}}\n", "<Document>: {}")


@dataclass
class HttpReranker:
    """Cross-encoders behind /rerank servers; reads either answer shape, asks for all passages."""

    endpoint: str
    model: Model = field(default_factory=Model)
    shape: str = "cohere"
    key: str = ""
    transport: Transport = send

    def score(self, question: str, passages: list[str]) -> list[float]:
        q, texts = self.model.wrap(question, passages)
        body = {"query": q, "texts": texts} if self.shape == "tei" else {"model": self.model.name, "query": q, "documents": texts, "top_n": len(texts)}
        got = Client(self.endpoint, self.key, self.transport).json("POST", "/rerank", body)
        rows = got.get("results", []) if isinstance(got, dict) else got
        out = [float("-inf")] * len(passages)
        for r in rows:
            if 0 <= r["index"] < len(out):
                out[r["index"]] = float(r.get("relevance_score", r.get("score", 0.0)))
        return out


@dataclass
class CohereReranker:
    """The hosted reranker; places outside the passages are skipped."""

    key: str
    model: str = "rerank-english-v3.0"
    endpoint: str = "https://api.cohere.com/v2"
    transport: Transport = send

    def score(self, question: str, passages: list[str]) -> list[float]:
        return HttpReranker(self.endpoint, Model(self.model), "cohere", self.key, self.transport).score(question, passages)


class _Generator:
    """Tokens of a prompt. complete() drains them, the shared prefix first."""

    def tokens(self, prompt: str, system: str = "") -> Iterator[str]:
        raise NotImplementedError

    def __call__(self, prefix: str, prompt: str) -> str:
        return "".join(self.tokens(prefix + prompt))


@dataclass
class OpenAIGenerator(_Generator):
    key: str
    model: str = "gpt-4o-mini"
    endpoint: str = "https://api.openai.com/v1"
    transport: Transport = send

    def tokens(self, prompt: str, system: str = "") -> Iterator[str]:
        text = f"{system}\n\n{prompt}" if system else prompt
        body = {"model": self.model, "stream": True, "messages": [{"role": "user", "content": text}]}
        for line in Client(self.endpoint, self.key, self.transport).call("POST", "/chat/completions", body).lines:
            line = line.decode().strip()
            if not line.startswith("data:"):
                continue
            data = line[5:].strip()
            if data == "[DONE]":
                return
            got = json.loads(data)
            if "error" in got:
                raise RuntimeError(str(got["error"]))
            for choice in got.get("choices", []):
                if piece := (choice.get("delta") or {}).get("content"):
                    yield piece


@dataclass
class OllamaGenerator(_Generator):
    model: str
    endpoint: str = "http://localhost:11434"
    think: bool = False
    num_ctx: int = 0
    transport: Transport = send

    def tokens(self, prompt: str, system: str = "") -> Iterator[str]:
        text = f"{system}\n\n{prompt}" if system else prompt
        body = {"model": self.model, "stream": True, "think": self.think, "messages": [{"role": "user", "content": text}]}
        if self.num_ctx > 0:
            body["options"] = {"num_ctx": self.num_ctx}
        for line in Client(self.endpoint, transport=self.transport, timeout=300.0).call("POST", "/api/chat", body).lines:
            if not line.strip():
                continue
            got = json.loads(line)
            if got.get("error"):
                raise RuntimeError(got["error"])
            if piece := (got.get("message") or {}).get("content"):
                yield piece
            if got.get("done"):
                return


class ScriptedGenerator(_Generator):
    """Offline: yields what it was given."""

    def __init__(self, tokens: list[str]):
        self._tokens = list(tokens)

    def tokens(self, prompt: str, system: str = "") -> Iterator[str]:
        yield from self._tokens
