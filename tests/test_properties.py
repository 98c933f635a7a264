"""Properties that hold for any input."""

import uuid

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestore.operators.chunking import SEPARATORS, split_recursively
from lodestore.operators.dense import cosine_table
from lodestore.operators.rerank import mmr_order
from lodestore.plans.flow import parse_grade
from lodestore.sources.readers import fold_sections, frontmatter, html_text, markdown_blocks

TEXT = st.text(alphabet="ab \n\té日.#`-*<>&", max_size=300)


@given(TEXT, st.integers(2, 40), st.data())
@settings(deadline=None)
def test_chunks_hold_every_letter_in_order(text, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    got = split_recursively(text, size, overlap)
    letters = [c for c in text if c not in " \n"]
    if overlap == 0:
        assert [c for p in got for c in p if c not in " \n"] == letters
    else:
        assert {c for p in got for c in p if c not in " \n"} == set(letters)
    longest = max(map(len, SEPARATORS))
    assert all(len(p.encode()) <= max(size + overlap + longest, 4 * size) for p in got)


@given(TEXT)
@settings(deadline=None)
def test_markdown_blocks_lose_nothing(text):
    blocks = markdown_blocks(text)
    body = "".join(t for level, t in blocks if level == 0)
    assert all(0 <= level <= 6 for level, _ in blocks)
    if not any(level for level, _ in blocks):
        assert body == text + "\n"
    fields, rest = frontmatter(text)
    assert rest in text
    assert all(isinstance(v, str) for v in fields.values())


@given(st.lists(st.tuples(st.integers(0, 4), st.text(alphabet="abc ", max_size=5)), max_size=12))
def test_sections_keep_bodies(blocks):
    got = fold_sections(blocks)
    body = "".join(t for level, t in blocks if level == 0)
    if body.strip():
        assert sorted(c for _, t in got for c in t if c != " ") == sorted(c for c in body if c != " ")
    for path, text in got:
        assert text == text.strip()
        assert not path.startswith(" > ")


@given(TEXT)
def test_html_text_has_no_tags_left(text):
    got = html_text(text)
    assert got == got.strip()
    assert len(got) <= len(text) + 1


@given(st.text(max_size=80), st.integers(0, 12))
def test_grades_stay_in_range(reply, n):
    found, missing, readable = parse_grade(reply, n)
    assert all(0 <= i < n for i in found)
    assert len(set(found)) == len(found)
    assert not (found and missing)
    assert readable or not found


@given(st.integers(1, 8), st.integers(1, 8), st.floats(0, 1))
@settings(deadline=None)
def test_mmr_picks_each_once(m, n, lam):
    rng = np.random.default_rng(m * 100 + n)
    vectors = [rng.normal(size=3) for _ in range(m)]
    got = mmr_order(rng.normal(size=3), vectors, rng.random(m), n, lam)
    assert len(got) == min(m, n) == len(set(got))
    if lam == 1:
        return
    assert abs(cosine_table(np.stack(vectors), np.stack(vectors)).diagonal() - 1).max() < 1e-9


@given(st.text(max_size=30))
def test_uuid_of_any_name_is_a_uuid(name):
    assert uuid.uuid5(uuid.NAMESPACE_URL, name).version == 5
