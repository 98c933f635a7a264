import os
import random

import pytest

from lodestore.llm.encoding import VOCABULARY, decode, decode_corpus, encode_corpus, word_blocks

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="the vocabulary is not there")
JSON = os.path.join(os.path.dirname(VOCABULARY), "byte_bpe_50k.json")

TEXTS = ["", None, " ", "Hello world", "don't we'll I'm", "  two  blanks \n\n lines\t", "äöü ß 日本語 Привет", "👩‍🔧🇩🇪 x²½", "<|endoftext|> is text", "\ufeffnote\u200b\u00a0x", "a" * 5000, "0x9D82 1,234.5 −5 ٣٤", "\r\nx\r\n ", "e\u0301\x00\x07"]


def rows():
    rng = random.Random(1)
    some = ["".join(rng.choice("ab c.\n12é'") for _ in range(rng.randint(0, 300))) for _ in range(60)]
    return [(i, t, 1, "x") for i, t in enumerate(TEXTS + some)]


def expected():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return {i: t.encode(x or "", add_special_tokens=False).ids for i, x, *_ in rows()}


def test_equals_the_library(spark):
    df = spark.createDataFrame(rows(), "doc_id bigint, text string, slots int, words string").repartition(5)
    got = {r.doc_id: r.ids for r in encode_corpus(df).collect()}
    assert got == expected()


def test_round_trip_and_lengths(spark):
    df = spark.createDataFrame(rows(), "doc_id bigint, text string, ids int, docs string")
    for r in encode_corpus(df).collect():
        assert decode(r.ids) == (rows()[r.doc_id][1] or "")
    got = {r.doc_id: r.n_tokens for r in encode_corpus(df, lengths_only=True).collect()}
    assert got == {i: len(x) for i, x in expected().items()}


def test_blocks_split_by_size(spark):
    df = spark.createDataFrame([(i, "word " * 100) for i in range(20)], "doc_id bigint, text string").coalesce(1)
    assert word_blocks(df, block_chars=1000).count() == 10


def test_empty_repeats_and_null_ids(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y")], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, len(r.ids)) for r in encode_corpus(df).collect()) == [(0, 1), (1, 1), (1, 1)]
    assert encode_corpus(df.limit(0)).count() == 0
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert [r.ids for r in encode_corpus(only).collect()] == [[], []]


@pytest.mark.parametrize("run", [4_096, 3])
def test_decoding_by_a_join_gives_the_texts_back(spark, run):
    table = spark.createDataFrame([*rows(), (3, "Hello world", 1, "x"), (None, "no id", 1, "x")], "doc_id bigint, text string, token int, bytes string")
    got = [(r.doc_id, r.text) for r in decode_corpus(encode_corpus(table), run=run).collect()]
    assert sorted(got, key=repr) == sorted([(r.doc_id, r.text or "") for r in table.collect()], key=repr)


def test_decoding_edges(spark):
    table = spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>")
    assert sorted((r.doc_id, r.text) for r in decode_corpus(table).collect()) == [(1, ""), (2, "")]
    assert decode_corpus(table.limit(0)).count() == 0
    with pytest.raises(Exception, match="no such token"):
        decode_corpus(spark.createDataFrame([(1, [999_999])], "doc_id bigint, ids array<int>")).collect()
