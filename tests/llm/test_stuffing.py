import dataclasses

import numpy as np
import pytest

from lodestore.llm import stuffing
from lodestore.llm.stuffing import Limits, Reader, _least, flagged, flowing, function_words, regular, stuffed_pages

PROSE = "Nobody on the team expected that the valve closes after ten days. We measured the flow before it was changed. "
KNOWN = frozenset("nobody on the that after we before it was in but so and has for only по в не и но er die der wenn nicht".split())
HAN = frozenset("的了是但没经")
read = Reader(KNOWN)

STUFFED = [
    "cheap pump buy pump pump sale " * 20,
    "buy cheap pump online. buy cheap hose online. buy cheap tank online. buy cheap sink online. " * 4,
    " ".join(f"https://www.a{i}.test/x/y{i}" for i in range(20)),
    PROSE[:66] + "\n" + "\n".join(f"Fast Pump Deal {i} - http://a.test/p{i}" for i in range(30)),
    "#pump #sale#hose #tank #sink #best #valve #motor #pipe #tool #bolt",
    "\n".join(["pump red XL", "hose blue", "tank steel 5kg", "sink", "valve oak", "motor grey M"] * 5),
    "*PUMP* *SALE* *PUMP* *BEST* *PUMP* *PUMP* *COUPON* *PUMP* *HOSE*",
    '<a href="http://a.test/1">red pump</a> <a href="http://a.test/2">blue pump</a> | <a href="http://a.test/3">old hose</a> <a href="http://a.test/4">new hose</a>',
    "buy pump buy pump buy pump",
]
#: Keywords among words of sentences: only repetition tells them.
WOVEN = ["where to buy pump in town " * 20, "so the pump in the pump for the pump and the pump but " * 6]


@pytest.mark.parametrize("text", STUFFED)
def test_stuffed(text):
    assert read(text)[0]


@pytest.mark.parametrize("text", WOVEN)
def test_repetition_among_function_words(text):
    known = KNOWN | {"where", "to"}
    assert Reader(known)(text)[0]


@pytest.mark.parametrize(
    "text",
    [
        None, "", " \n", "ok", "404", "pump pump", "pump hose tank sink",
        PROSE * 4,
        PROSE * 3 + "\nTags: pump, hose, tank, sink, valve, motor",
        PROSE * 3 + "\n" + "\n".join(f"- see http://a.test/{i}" for i in range(4)),
        "for x in y:\n    total += x.size\nreturn total[3]\nn = len(x)\nif n < 3 && m > 4 {\n}\n" * 3,
        "curl http://a.test/1\nn = len(x)\ncurl http://a.test/2\nreturn n\ncurl http://a.test/3\n}",
        "12 3.5 0xFF 99 1,234 5 6 7 8 9 10 11 12 13 " * 5,
        "7 7 7 7 7 7 7 7 7 7 7 7",
        "Ο δείκτης ελέγχει την πηγή σήμερα. Η αντλία δεν άλλαξε χθες ποτέ. Η βαλβίδα έκλεισε μόνη της.",
        "Notes, the pump in March\n\nThe pump was in the log but nobody has it.",
        "".join(map(chr, range(0x4E00, 0x4E00 + 900))),
    ],
)
def test_not_stuffed(text):
    assert not read(text)[0]


@pytest.mark.parametrize("text", ["便宜水泵" * 2500, "便宜水泵" * 4, "安いポンプ" * 2000, "ราคา" * 2500, "水泵价格阀门软管" * 300 + " http://a.test/1", "水泵便宜\n" + "水泵" * 400])
@pytest.mark.parametrize("known", [KNOWN, KNOWN | HAN])
def test_keywords_without_blanks(text, known):
    assert Reader(known)(text)[0]


@pytest.mark.parametrize("text", ["水泵", "便宜水泵", "第二周的更新已经推迟了会議，但是索引没有通过。昨天的引用已经替换了记录，但是阀门没有通过。"])
def test_no_keywords_without_blanks(text):
    assert not Reader(KNOWN | HAN)(text)[0]
    assert not read(text)[0]


def test_gaps_between_function_words():
    f = np.zeros(30, bool)
    f[[2, 6, 8]] = True
    assert flowing(f, 5).nonzero()[0].tolist() == list(range(9))
    assert not flowing(np.zeros(5, bool), 5).any()
    assert flowing(np.ones(3, bool), 5).all()


def test_regular_repetition():
    free = np.zeros(90, bool)
    assert regular(np.arange(90), free, Limits()).sum() == 0
    assert regular(np.tile([0, 1, 2], 30), free, Limits()).all()
    slots = np.stack([np.zeros(30), np.ones(30), np.arange(30) + 2], axis=1).ravel().astype(np.int64)  # two words and a new one
    assert regular(slots, free, Limits()).mean() > 0.9
    assert regular(np.tile([0, 1, 2], 30), ~free, Limits()).sum() == 0
    mixed = np.concatenate([np.arange(100, 150), np.tile([0, 1, 2, 3, 4, 5], 10)])
    at = regular(mixed, np.zeros(len(mixed), bool), Limits())
    assert at[60:].mean() > 0.9
    assert at[:40].sum() == 0


def test_each_part_of_the_method_decides():
    """Without the gaps of function words lists are missed, without repetition the woven keywords."""
    known = KNOWN | {"where", "to"}
    no_gaps = Reader(known, dataclasses.replace(Limits(), gap=10**9))
    lists = [t for t in STUFFED if not no_gaps(PROSE + t)[0]]
    assert len(lists) >= 2
    assert all(Reader(known)(t)[0] for t in STUFFED + WOVEN)

    def none(codes, free, limits):
        return np.zeros(len(codes), bool)

    kept, stuffing.regular = stuffing.regular, none
    try:
        assert not any(Reader(known)(t)[0] for t in WOVEN)
    finally:
        stuffing.regular = kept


def test_least_count():
    assert _least(1, 0.05) == 2
    assert _least(3, 0.05) == 3
    assert 9 < _least(100, 0.05) < 20
    assert _least(3, 0.9) == 4


def test_long_page_ends():
    assert read("pump sale " * 200_000)[0]


NOUNS = ("pump", "valve", "log", "hose", "tank", "sink", "motor", "bolt")


def corpus(spark):
    prose = [f"The {a} was in the {b} before it closed. Nobody has seen that the {b} of the {a} is old. It is {c}." for a in NOUNS for b in NOUNS for c in ("warm", "cold") if a != b]
    lists = [" ".join(NOUNS[i:] + NOUNS[:i]) + f" sale {i}" for i in range(8)]
    rows = [(i, t, "en") for i, t in enumerate(prose + lists)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), len(prose)


def test_function_words_are_learnt(spark):
    df, _ = corpus(spark)
    got = function_words(df, "text", "lang")
    assert {"the", "was", "in", "before", "it", "nobody", "that", "of", "is"} <= got
    assert not got & set(NOUNS)
    assert function_words(df, "text") == got
    assert function_words(df.limit(0)) == frozenset()
    # copies of a page of keywords that end like sentences do not teach its words
    spam = spark.createDataFrame([(1000 + i, "buy cheap gadget online. " * 30, None) for i in range(200)], df.schema)
    assert not function_words(df.unionByName(spam).coalesce(2), "text", "lang") & {"buy", "cheap", "gadget", "online"}


def test_tables(spark):
    df, n = corpus(spark)
    more = [(900, "cheap gadget " * 30, "xx"), (900, "cheap gadget " * 30, None), (901, None, "en"), (None, "cheap gadget " * 30, "en"), (902, "  ", "")]
    df = df.unionByName(spark.createDataFrame(more, df.schema)).selectExpr("*", "1 AS stuffed", "'x' AS flow")
    got = sorted(r.doc_id for r in flagged(stuffed_pages(df, lang_col="lang")).collect())
    assert got == [*range(n, n + 8), 900]
    assert flagged(stuffed_pages(df.limit(0), lang_col="lang")).count() == 0
    assert stuffed_pages(df.where("doc_id > 899"), lang_col="lang").where("stuffed").count() == 2  # nothing learnt: repetition tells
