"""Encoding of a whole corpus with a public tokenizer: each distinct word once.

Texts are cut into pre-tokens by the tokenizer's own pattern. A block of documents keeps, per document, the
sequence of positions as slots of the block's list of distinct words; only those lists are exploded with their
positions and shuffled by word, so a word that fills a third of the corpus sends one row per block. Every distinct
word is encoded once for the whole corpus, its ids go back to the slots, and a block puts its documents together
again by position. Decoding goes the other way: ids meet the table of token bytes in a join, and the bytes of a
document are put together by position.

Defined results
* A null or an empty text has an empty list of ids; text that looks like a special token is ordinary text.
* Repeated rows of a document stay; null document ids are kept. An empty table gives an empty result.
* Texts of any length are whole: a long text is a block of its own.
* Only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import functools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed: the pattern that cuts text before the merges of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=2)
def _ranks(vocabulary: str) -> dict[bytes, int]:
    with open(vocabulary, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}


@functools.lru_cache(maxsize=2)
def _merger(vocabulary: str):
    """Encodes one whole pre-token: a pattern that takes everything."""
    import tiktoken

    return tiktoken.Encoding("whole", pat_str=r"(?s).+", mergeable_ranks=_ranks(vocabulary), special_tokens={})


@functools.lru_cache(maxsize=1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


def decode(ids: list[int], vocabulary: str = VOCABULARY) -> str:
    """The text of ids, by the table of token bytes."""
    return b"".join(_token_bytes(vocabulary)[i] for i in ids).decode("utf-8")


@functools.lru_cache(maxsize=2)
def _token_bytes(vocabulary: str) -> dict[int, bytes]:
    return {i: b for b, i in _ranks(vocabulary).items()}


_BLOCKS = pa.schema([("block", pa.string()), ("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("slots", pa.binary()), ("words", pa.list_(pa.string()))])


def word_blocks(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 1_000_000) -> DataFrame:
    """(block, docs, lengths, slots, words): documents as positions over their block's distinct words."""

    def cut(batches):
        findall = _pattern().findall

        def close(docs, seqs, slot):
            lengths = [len(s) for s in seqs]
            flat = np.concatenate([np.asarray(s, dtype=np.int32) for s in seqs]) if sum(lengths) else np.zeros(0, np.int32)
            return pa.record_batch([pa.array([uuid.uuid4().hex]), pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), pa.array([flat.tobytes()], pa.binary()), pa.array([list(slot)], pa.list_(pa.string()))], schema=_BLOCKS)

        docs, seqs, slot, size = [], [], {}, 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                if docs and size + len(text) > block_chars:
                    yield close(docs, seqs, slot)
                    docs, seqs, slot, size = [], [], {}, 0
                docs.append(doc)
                seqs.append([slot.setdefault(w, len(slot)) for w in findall(text)])
                size += len(text)
        if docs:
            yield close(docs, seqs, slot)

    schema = "block string, docs array<bigint>, lengths array<int>, slots binary, words array<string>"
    return documents.select(F.col(id_col).cast("bigint").alias("d"), F.col(text_col).cast("string").alias("t")).mapInArrow(cut, schema)


def word_ids(words: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(word, ids) for distinct words."""

    def merge(batches):
        encode = _merger(vocabulary).encode_ordinary
        for batch in batches:
            got = batch.column(0).to_pylist()
            yield pa.record_batch([pa.array(got, pa.string()), pa.array([encode(w) for w in got], pa.list_(pa.int32()))], names=["word", "ids"])

    return words.mapInArrow(merge, "word string, ids array<int>")


def encode_corpus(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, lengths_only: bool = False) -> DataFrame:
    """(id, ids array<int>), or (id, n_tokens bigint) with lengths_only: then only lengths travel."""
    blocks = written(word_blocks(documents, id_col, text_col), "blocks")
    slots = blocks.select("block", F.posexplode("words").alias("slot", "word"))
    coded = word_ids(slots.select("word").distinct(), vocabulary)
    value = (F.size("ids") if lengths_only else F.col("ids")).alias("value")
    back = slots.join(coded.select("word", value), "word").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("slot", "value"))).alias("table"))
    joined = blocks.select("block", "docs", "lengths", "slots").join(back, "block", "left").select("docs", "lengths", "slots", F.col("table.value").alias("value"))
    out = f"`{id_col}` bigint, " + ("n_tokens bigint" if lengths_only else "ids array<int>")

    def rebuild(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                docs = batch.column(0)[row].values
                ends = np.concatenate([[0], np.cumsum(batch.column(1)[row].values.to_numpy(zero_copy_only=False))]).astype(np.int64)
                slot = np.frombuffer(batch.column(2)[row].as_py(), dtype=np.int32)
                value = batch.column(3)[row].values
                if lengths_only:
                    per = value.to_numpy(zero_copy_only=False)[slot] if len(slot) else np.zeros(0, np.int64)
                    total = np.concatenate([[0], np.cumsum(per)])
                    yield pa.record_batch([docs, pa.array(total[ends[1:]] - total[ends[:-1]], pa.int64())], names=[id_col, "n_tokens"])
                    continue
                if not len(slot):
                    offsets, flat = np.zeros(len(docs) + 1, np.int32), pa.array([], pa.int32())
                else:
                    starts = value.offsets.to_numpy().astype(np.int64)
                    ids = value.values.to_numpy(zero_copy_only=False)
                    size = (starts[1:] - starts[:-1])[slot]
                    at = np.concatenate([[0], np.cumsum(size)])
                    take = np.arange(at[-1]) - np.repeat(at[:-1], size) + np.repeat(starts[:-1][slot], size)
                    flat, offsets = pa.array(ids[take], pa.int32()), at[ends].astype(np.int32)
                yield pa.record_batch([docs, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], names=[id_col, "ids"])

    return joined.mapInArrow(rebuild, out)


def token_bytes(spark: SparkSession, vocabulary: str = VOCABULARY) -> DataFrame:
    """(token, bytes): the table of token bytes; its size is that of the vocabulary."""
    return spark.createDataFrame([(i, bytearray(b)) for b, i in _ranks(vocabulary).items()], "token int, bytes binary")


def decode_corpus(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY, run: int = 4_096) -> DataFrame:
    """(id, text): the text of each row's ids by a join with the table of token bytes.

    Rows are told apart by a number of their own, so repeated and null ids stay. Ids travel in runs of `run`; a run is
    exploded by position, joined and put together, then the runs of a row are. A null or an empty list gives an empty
    text; an id that the table lacks fails.
    """
    ids = F.coalesce(F.col(ids_col), F.array().cast("array<int>"))
    rows = written(encoded.select(F.col(id_col).alias("d"), ids.alias("ids"), F.expr("uuid()").alias("row")), "ids")
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.size("ids") - 1, F.lit(0)), F.lit(run)), lambda at: F.slice("ids", at + 1, run))
    tokens = rows.select("row", F.posexplode(parts).alias("part", "p")).select("row", "part", F.posexplode("p").alias("at", "token"))
    # Every token of the corpus meets a table of fixed size: broadcast, no token is hot.
    joined = tokens.join(F.broadcast(token_bytes(encoded.sparkSession, vocabulary)), "token", "left")
    got = F.coalesce(F.col("bytes"), F.raise_error(F.format_string("no such token: %s", F.col("token").cast("string"))).cast("binary"))
    inner = joined.groupBy("row", "part").agg(F.sort_array(F.collect_list(F.struct("at", got.alias("b")))).alias("t"))
    inner = inner.select("row", "part", F.array_join(F.transform("t", lambda x: F.hex(x["b"])), "").alias("h"))
    outer = inner.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("part", "h"))).alias("t"))
    texts = outer.select("row", F.decode(F.unhex(F.array_join(F.transform("t", lambda x: x["h"]), "")), "utf-8").alias("text"))
    return rows.select("row", "d").join(texts, "row", "left").select(F.col("d").alias(id_col), F.coalesce("text", F.lit("")).alias("text"))
