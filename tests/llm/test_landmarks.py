import random
import re

import pytest

from lodestore.llm.landmarks import LEVELS, Text, boundaries, coarsest_boundary, landmarks, pieces, split_oversized

EDGE = " \t\r\n"


def text_of(seed, n=4000):
    rng = random.Random(seed)
    out = []
    while sum(map(len, out)) < n:
        out.append("".join(rng.choice("abcdefgéß日") for _ in range(rng.randint(1, 12))) + rng.choice([" ", " ", " ", "\n", "\n\n", ". "]))
    return "".join(out)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize(("limit", "overlap"), [(200, 0), (300, 30), (1000, 100)])
def test_pieces_are_within_the_limit_and_whole(seed, limit, overlap):
    text = text_of(seed)
    got = pieces(text, limit, overlap)
    assert all(0 < len(p.encode()) <= limit for p in got)
    assert all(p == p.strip(EDGE) for p in got)
    at = 0
    for p in got:  # each piece starts where the one before ends, or earlier
        found = text.find(p, max(0, at - overlap - limit))
        assert found >= 0
        assert not text[at:found].strip(EDGE)
        if at and overlap:
            assert found <= at
        at = max(at, found + len(p))
    assert not text[at:].strip(EDGE)


def test_an_edit_moves_only_near_cuts():
    text = text_of(3, 40_000)
    before = set(pieces(text, 1000, 0))
    after = set(pieces(text[:20_000] + "inserted " + text[20_000:], 1000, 0))
    assert len(before - after) <= 4


def test_overlap_repeats_the_end_of_the_piece_before():
    got = pieces("word " * 400, 200, 40)
    for a, b in zip(got, got[1:]):
        assert b[:30] in a


@pytest.mark.parametrize(
    ("text", "want"),
    [("aaaa\n\nbbbb", "paragraph"), ("aaaa\n \t\nbbbb", "paragraph"), ("aaaa\nbbbb", "line"), ("aaaa bbbb", "word"), ("aaaabbbb", "none"), ("aaa\n\nbbb\nccc", "line"), ("ééé éé", "none")],
)
def test_boundary(text, want):
    assert coarsest_boundary(Text(text), 5) == want


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("limit", [12, 40, 150, 400])
def test_the_cutter_finds_the_boundary_that_splitting_finds(seed, limit):
    text = text_of(seed, 1500)
    cuts = (r"\n[^\S\n]*\n\s*", r"\n\s*", r"\s+")
    want = next((level for level, cut in zip(LEVELS, cuts) if all(len(p.strip(EDGE).encode()) <= limit for p in re.split(cut, text))), "none")
    assert coarsest_boundary(Text(text), limit) == want


@pytest.mark.parametrize("overlap", [0, 10, 49, 80, 95])
def test_any_overlap_below_the_limit_is_kept(overlap):
    text = " ".join(f"w{i}" for i in range(400))
    held = Text(text)
    cuts = held.cuts(100, overlap, held.kinds)
    assert all(start - head == min(overlap, start) for head, start, _ in cuts)
    assert all(stop - head <= 100 for head, _, stop in cuts)
    assert all(not text[stop:start].strip() for (_, _, stop), (_, start, _) in zip(cuts, cuts[1:]))
    assert (cuts[0][0], cuts[-1][2]) == (0, len(text))
    assert pieces(text, 100, overlap) == [text[head:stop].strip() for head, _, stop in cuts]


@pytest.mark.parametrize("overlap", [-1, 100, 101])
def test_an_overlap_that_cannot_be_kept_is_an_error(overlap):
    with pytest.raises(ValueError, match="overlap"):
        pieces("abcde " * 100, 100, overlap)


def test_landmarks_depend_on_nearby_bytes_only():
    import numpy as np

    a = np.frombuffer(random.Random(1).randbytes(5000), np.uint8)
    b = np.concatenate([np.zeros(100, np.uint8), a])
    assert set(landmarks(a, 64) + 100) <= set(landmarks(b, 64))
    assert len(landmarks(a[:10], 64)) == 0


def test_tables(spark):
    rows = [("document", "a", "x" * 30, 1, "b"), ("document", "a", "x" * 30, 2, "b"), ("document", "s", "short", 1, "b"), ("document", "n", None, 1, "b"), ("document", "w", " " * 30, 1, "b"), ("chunk", "c", "one two three four", 1, "b"), ("other", "o", "y" * 99, 1, "b"), ("document", None, "z" * 99, 1, "b")]
    df = spark.createDataFrame(rows, "record string, item_id string, content string, idx int, boundary string")
    limits = spark.createDataFrame([("document", 20, 2), ("chunk", 10, 0), ("chunk", 10, None), (None, 1, 1)], "record string, max_bytes int, overlap_bytes int")
    got = {tuple(r) for r in boundaries(split_oversized(df, limits)).collect()}
    assert got == {("document", "a", "none"), ("document", "w", "paragraph"), ("chunk", "c", "word")}
    made = split_oversized(df, limits).where("item_id = 'c'").orderBy("idx").collect()
    assert [r.idx for r in made] == list(range(len(made)))
    assert boundaries(split_oversized(df.limit(0), limits)).count() == 0
    assert boundaries(split_oversized(df, limits.limit(0))).count() == 0


def test_one_very_long_word():
    got = pieces("é" * 200_000, 1000, 100)
    assert all(len(p.encode()) <= 1000 for p in got)
    assert len("".join(got)) >= 200_000
