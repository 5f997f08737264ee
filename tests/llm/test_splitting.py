import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sagebrook.llm.splitting import forced, soundness, split_oversized, split_text


@given(st.text(alphabet="ab. \n,;", max_size=400), st.integers(20, 60), st.integers(0, 15))
@settings(max_examples=200, deadline=None)
def test_pieces_cover_overlap_and_fit(text, limit, overlap):
    pieces = split_text(text, limit, overlap)
    if not text:
        assert pieces == []
        return
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(0 < e - s <= limit for s, e, _ in pieces)
    if len(text) > limit:
        assert all(b[0] == a[1] - overlap for a, b in zip(pieces, pieces[1:]))


def test_prefers_natural_boundaries():
    text = "One two three four five. " * 20
    cuts = [text[e - 2 : e] for _, e, _ in split_text(text, 120, 10)[:-1]]
    assert set(cuts) == {". "}


def test_operator(spark):
    random.seed(3)
    long, code = "Some words here. " * 30, "x" * 300
    rows = [("a", long, 10, 1), ("a", long, 10, 2), ("b", code, None, 1), ("c", "short", 0, 1), ("d", None, 0, 1), (None, long, 0, 1), ("e", long, 0, 1), ("e", "now short", 0, 2)]
    df = spark.createDataFrame(rows, "id string, content string, char_offset_start int, ingested_at int").selectExpr("*", "'s' AS section_path", "1 AS piece_no")
    got = split_oversized(df, 100, 20).orderBy("chunk_id", "piece_no").collect()
    assert {r["chunk_id"] for r in got} == {"a", "b"}
    for r in got:
        if r["chunk_id"] == "a":
            at = r["char_offset_start"] - 10
            assert long[at : r["char_offset_end"] - 10] == r["content"] and r["cut_kind"] == "natural" and r["section_path"] == "s"
        else:
            assert r["char_offset_start"] is None and r["cut_kind"] == "forced"
    assert split_oversized(df.limit(0), 100, 20).count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, 10, 10)


@given(st.lists(st.sampled_from(["abcdefgh", "x" * 45, "c" * 61, ". ", " ", ",", "\n", "。"]), max_size=30).map("".join), st.integers(0, 15))
@settings(max_examples=200, deadline=None)
def test_forced_is_a_stretch_beyond_the_limit(text, overlap):
    """The verdict from the cuts equals that from the whole text."""
    if len(text) > 60:
        longest = max(map(len, re.split(r"[\s.!?…。！？]", text)))
        assert forced(text, split_text(text, 60, overlap), 60) == (longest > 60)


def test_soundness(spark):
    text = "".join(f"Some words {i * 37} here. " for i in range(30))
    chunks = spark.createDataFrame([("a", text, 0, 1), ("b", "y" * 250, None, 1), ("c", "short", 0, 1)], "id string, content string, char_offset_start int, ingested_at int").selectExpr("*", "'s' AS section_path")
    pieces = split_oversized(chunks, 100, 20)
    assert {tuple(r) for r in soundness(pieces, chunks, 100, 20).collect()} == {("a", True, True, True), ("b", True, True, True)}
    broken = pieces.where("NOT (chunk_id = 'a' AND piece_no = 2) AND chunk_id <> 'b'")
    assert {tuple(r) for r in soundness(broken, chunks, 100, 20).collect()} == {("a", False, True, False), ("b", False, False, False)}
