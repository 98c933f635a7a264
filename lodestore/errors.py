"""Errors raised to the caller. What a stage absorbs is a nullable text column instead."""

from __future__ import annotations


class LodestoreError(Exception):
    """Base of all errors of this library."""


def _kind(name: str, text: str) -> type[LodestoreError]:
    return type(name, (LodestoreError,), {"__doc__": text, "__init__": lambda self, detail="": LodestoreError.__init__(self, f"{text}: {detail}" if detail else text)})


EmptyDocument = _kind("EmptyDocument", "document is empty")
DocumentTooLarge = _kind("DocumentTooLarge", "document exceeds the size limit")
UnsupportedFormat = _kind("UnsupportedFormat", "unsupported document format")
EmptyQuery = _kind("EmptyQuery", "query is empty")
EmptySource = _kind("EmptySource", "source name is empty")
NoResults = _kind("NoResults", "no results found")
NoChunks = _kind("NoChunks", "chunker returned no chunks")
EmptyEmbeddings = _kind("EmptyEmbeddings", "embedder returned no vectors")
CountMismatch = _kind("CountMismatch", "number of results differs from number of inputs")
DimensionMismatch = _kind("DimensionMismatch", "vector has another dimension")
MissingReader = _kind("MissingReader", "no reader is configured")
MissingChunker = _kind("MissingChunker", "no chunker is configured")
MissingStore = _kind("MissingStore", "neither a vector nor an index store is configured")
MissingEmbedder = _kind("MissingEmbedder", "a vector store needs an embedder")
MissingGenerator = _kind("MissingGenerator", "no generator is configured")
NotDeletable = _kind("NotDeletable", "a store cannot delete by source")
MaxSteps = _kind("MaxSteps", "workflow exceeded its step limit")
UnknownStep = _kind("UnknownStep", "workflow has no such step")
Cancelled = _kind("Cancelled", "the call was cancelled")
Conflict = _kind("Conflict", "another writer published first")
