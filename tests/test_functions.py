"""Micro-cases derived by hand."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sagebrook.functions import citations, replies, text
from sagebrook.functions.providers import TransientError, first_that_works, configured, embedded, first_that_starts, for_evaluation, md5_embedding, with_retry
from sagebrook.operators import packing, records, retrieval, tables


def one(spark, col, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'long'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(("given_", "lang", "want"), [("abcd", "tr", 2), ("abcd", "en", 1), ("", "en", 0)])
def test_tokens(spark, given_, lang, want):
    assert one(spark, text.estimated_tokens(F.col("t"), F.col("l")), t=given_, l=lang) == want


def test_document_language_is_strict(spark):
    for n, want in ((5, "en"), (6, "tr")):
        assert one(spark, text.document_language(F.col("t")), t="ş" * n + "a" * (1000 - n)) == want
    assert one(spark, text.document_language(F.col("t")), t=None) == "en"


@pytest.mark.parametrize(("q", "want"), [("What is X?", "en"), ("ağrı", "tr"), ("ısı", "tr"), ("", "en")])
def test_query_language(spark, q, want):
    assert one(spark, text.query_language(F.col("t")), t=q) == want


def test_text_cleaning(spark):
    assert one(spark, text.without_tags(F.col("t")), t="a<b>b</b>  c") == "ab c"
    assert one(spark, text.normal_title(F.col("t")), t="Étude: A-B  (2020)") == "tude a b 2020"
    assert one(spark, text.collapsed(F.col("t")), t="  a　\n b ﻿") == "a b"
    assert one(spark, text.without_pdf_suffix(F.col("t")), t="x.PDF\n") == "x.PDF\n"


@pytest.mark.parametrize(("n", "want"), [(None, "0 B"), (1023, "1023 B"), (1536, "1.5 KB"), (10240, "10 KB"), (5 * 1024**4, "5120 GB")])
def test_bytes(spark, n, want):
    assert spark.createDataFrame([(n,)], "n long").select(text.listed_bytes(F.col("n")).alias("x")).first()["x"] == want


def test_validation_cases(spark):
    answer = "A fact [^1]. Another fact. [^2]\n**Key Findings**\n1. Item [^9]"
    v = one(spark, citations.validation(F.col("t"), F.lit(3), 0.6), t=answer)
    assert (v["cited"], v["valid"], v["invalid"], v["total"], v["uncited"], v["coverage"], v["ok"]) == (["1", "2", "9"], ["1", "2"], ["9"], 4, 2, 0.5, False)
    for threshold, ok in ((0.6, False), (0.5, True)):
        v = one(spark, citations.validation(F.col("t"), F.lit(1), threshold), t="Alpha [^1]. Beta.")
        assert (v["coverage"], v["ok"]) == (0.5, ok)
    v = one(spark, citations.validation(F.col("t"), F.lit(3), 0.6), t="")
    assert (v["total"], v["coverage"], v["ok"]) == (0, 0.0, False)


@given(st.text(alphabet="ab [^1]23.!?\n*#", max_size=60))
@settings(max_examples=25, deadline=None)
def test_validation_adds_up(spark, t):
    v = one(spark, citations.validation(F.col("t"), F.lit(3), 0.6), t=t)
    assert len(v["valid"]) + len(v["invalid"]) == len(v["cited"])
    assert 0 <= v["coverage"] <= 1
    assert "".join(one(spark, citations.text_parts(F.col("t")), t=t)) == t


def test_replies(spark):
    assert one(spark, F.slice(replies.reordered(F.col("t"), F.lit(6)), 1, 4), t="3, 0, 7, 3, 99") == [3, 0, 1, 2]
    assert one(spark, replies.reordered(F.col("t"), F.lit(0)), t="1") == []
    for reply, want in (("Score: 0.85", 0.85), (".5", 0.5), ("1/10", 1.0), ("8", 1.0), ("none", 0.0)):
        assert one(spark, replies.judged(F.col("t")), t=reply) == want
    assert one(spark, replies.field(F.col("t"), "a", "none"), t='```json\n{"a": " x "}\n```') == "x"
    assert one(spark, replies.field(F.col("t"), "a", "none"), t="no object") == "none"


def test_packing_cases(spark):
    def packed(lens):
        rows = spark.createDataFrame([(1, "en", ["a" * n for n in lens])], "k long, language string, p array<string>")
        return [(r["first"], r["last"], r["tokens"], r["long"]) for r in packing.pack_chunks(rows, "k", "p", "language").orderBy("chunk_no").collect()]

    assert packed([200, 1600, 120, 1520, 1924]) == [(0, 1, 450, False), (2, 3, 410, False), (4, 4, 481, True)]
    assert packed([800, 800]) == [(0, 0, 200, False), (1, 1, 200, False)]
    assert packed([316, 1920]) == [(0, 1, 559, False)]
    assert packed([]) == []


@given(st.lists(st.integers(0, 700), max_size=25))
@settings(max_examples=15, deadline=None)
def test_packing_in_batches(spark, sizes):
    rows = spark.createDataFrame([(1, "en", ["a" * (4 * n) for n in sizes])], "k long, language string, p array<string>")
    got = [(r["first"], r["last"], r["tokens"], r["long"]) for r in packing.pack_chunks(rows, "k", "p", "language").orderBy("chunk_no").collect()]
    assert got == packing.packed(sizes)
    assert all(t <= 559 or alone for _, _, t, alone in got)


def test_fusion(spark):
    v = spark.createDataFrame([("a", 1, 0.9), ("b", 2, 0.8), ("c", 3, 0.7)], "id string, rank int, similarity double")
    w = spark.createDataFrame([("b", 1, 0.3), ("d", 2, 0.2)], "id string, rank int, score double")
    got = retrieval.fuse(v, w).collect()
    assert [(r["id"], round(r["score"], 6), r["sources"]) for r in got] == [("b", 0.032522, "vector,keyword"), ("a", 0.016393, "vector"), ("d", 0.016129, "keyword"), ("c", 0.015873, "vector")]
    x, y = (spark.createDataFrame([(i, 1, 0.5)], f"id string, rank int, {c} double") for i, c in (("y", "similarity"), ("x", "score")))
    assert [r["id"] for r in retrieval.fuse(x, y).collect()] == ["y", "x"]


def test_cover_density(spark):
    rows = spark.createDataFrame([("1", "a b x a"), ("2", "a x x b"), ("3", "a a"), ("4", None)], "id string, content string")
    got = {r["id"]: round(r["score"], 4) for r in retrieval.lexical_top(rows, ["a", "b"]).collect()}
    assert got == {"1": round(0.1 + 0.1 / 2, 4), "2": round(0.1 / 3, 4)}
    assert {r["id"]: round(r["score"], 4) for r in retrieval.lexical_top(rows, ["a"]).collect()} == {"1": 0.2, "2": 0.1, "3": 0.2}


def test_vector_edges(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [2.0, 0.0])], "id string, embedding array<float>")
    assert [r["id"] for r in retrieval.vector_top(rows, [1.0, 0.0]).collect()] == ["a", "d"]
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0])], "query_id long, embedding array<float>")
    assert [(r["query_id"], r["id"], r["rank"]) for r in retrieval.vector_search(rows, asked, 1).collect()] == [(1, "a", 1)]
    assert retrieval.vector_search(rows.limit(0), asked).count() == retrieval.vector_search(rows, asked.limit(0)).count() == 0


def test_searches_keep_to_tenant_and_documents(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 3)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 1)
    rows = spark.createDataFrame([(f"{t}{i}", t, f"d{i % 2}", [1.0, float(i)], "doz tablet su" if i % 3 else "doz su") for t in "xy" for i in range(8)], "id string, tenant_id string, document_id string, embedding array<float>, content string")
    asked = spark.createDataFrame([("q1", "x", [1.0, 7.0], "Tabletler ve doz?", None), ("q2", "y", [1.0, 7.0], "su", ["d0"]), ("q3", "y", [1.0, 0.0], "ve", [])], "query_id string, tenant_id string, embedding array<float>, text string, document_ids array<string>")
    near = retrieval.vector_search(rows, asked, 3, tenant="tenant_id", document="document_id").orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"]) for r in near] == [("q1", "x7"), ("q1", "x6"), ("q1", "x5"), ("q2", "y6"), ("q2", "y4"), ("q2", "y2"), ("q3", "y0"), ("q3", "y1"), ("q3", "y2")]
    stored = retrieval.stored_postings(rows, keep=("tenant_id", "document_id"))
    words = retrieval.lexical_search(stored, asked, 9, tenant="tenant_id", document="document_id").collect()
    assert {(r["query_id"], r["id"]) for r in words} == {("q1", f"x{i}") for i in (1, 2, 4, 5, 7)} | {("q2", f"y{i}") for i in (0, 2, 4, 6)}


def test_rerank_fails_softly_and_spares_short_lists(spark):
    candidates = spark.createDataFrame([(q, i + 1, f"{q}{i}") for q, n in (("a", 5), ("b", 2), ("c", 4)) for i in range(n)], "query_id string, place int, id string")
    prompts = spark.createDataFrame([("a", "ok"), ("b", "never"), ("c", "fail")], "query_id string, prompt string")

    def call(prompt):
        if prompt != "ok":
            raise RuntimeError(prompt)
        return "3, 0, 9"

    got = retrieval.reranked(candidates, prompts, call, 3).orderBy("query_id", "place").collect()
    assert [r["id"] for r in got] == ["a3", "a0", "a1", "b0", "b1", "c0", "c1", "c2"]


def test_papers_keep_the_longest_abstract(spark):
    rows = [("d1", "", "A", "x" * 50, 1), ("", "p1", "B", "x" * 60, 2), ("d1", "", "C", "x" * 80, 3), ("", "", "E", "x" * 45, 4), ("", "", "e", "y" * 45, 5)]
    papers = spark.createDataFrame(rows, "doi string, pmid string, title string, abstract string, position long")
    got = records.distinct_papers(papers)
    assert sorted((r["title"], r["first_position"]) for r in got.collect()) == [("B", 2), ("C", 1), ("E", 4)]
    assert [r["title"] for r in records.distinct_papers(papers, 2).orderBy("first_position").collect()] == ["C", "B"]
    assert records.distinct_papers(got.withColumnRenamed("first_position", "position")).count() == 3


def test_tables(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k long, v string")
    assert sorted(map(tuple, tables.upsert(old, new, "k", ["v"]).collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert sorted(map(tuple, tables.insert_if_absent(old, new, "k").collect())) == [(1, "a"), (2, "b"), (3, "C")]
    twice = spark.createDataFrame([(2, "x"), (2, "y"), (9, "q"), (9, "p"), (None, "n")], "k long, v string")
    assert sorted(map(tuple, tables.upsert(old, twice, "k", ["v"]).collect())) == [(1, "a"), (2, "y"), (9, "q")]
    assert sorted(map(tuple, tables.insert_if_absent(old, twice, "k").collect())) == [(1, "a"), (2, "b"), (9, "p")]
    assert tables.upsert(old.limit(0), twice.limit(0), "k", ["v"]).count() == 0
    parents, children = tables.delete_with_children(old, new.withColumnRenamed("k", "p"), "k", "p", F.col("v") == "b")
    assert (parents.count(), children.count()) == (1, 1)


def test_slots():
    calls, slept = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise TransientError
        return x

    assert with_retry(flaky, sleep=slept.append)(5) == 5
    assert slept == [1.0, 2.0]
    with pytest.raises(ValueError):
        with_retry(lambda: (_ for _ in ()).throw(ValueError()), sleep=slept.append)()
    assert first_that_works([lambda: 1 / 0, lambda: 2])() == 2
    assert md5_embedding("a b c") == md5_embedding("a b c") != md5_embedding("a b d") and len(md5_embedding("", 70)) == 70
    assert configured({"a": None, "b": len}) == [len]
    slept.clear()
    with pytest.raises(ZeroDivisionError):
        for_evaluation(lambda: 1 / 0, slept.append)()
    assert slept == [3.0, 6.0, 9.0, 12.0]


def test_streams_change_providers_before_the_first_piece_only():
    def down(prompt):
        raise ConnectionError
        yield

    def breaks(prompt):
        yield "a"
        raise ValueError

    assert list(first_that_starts([down, lambda p: iter([p, "!"])])("x")) == ["x", "!"]
    got = []
    with pytest.raises(ValueError):
        for piece in first_that_starts([breaks, lambda p: iter("zz")])("x"):
            got.append(piece)
    assert got == ["a"]
    with pytest.raises(ConnectionError):
        list(first_that_starts([down])("x"))


def test_requests_keep_the_providers_limit_and_fit(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "k long, t string").coalesce(1)
    got = embedded(rows, "k", "t", lambda texts: [[float(len(texts))]] * len(texts), batch=64, most=4, width=1).collect()
    assert sorted(r["embedding"][0] for r in got) == [2.0] * 2 + [4.0] * 8
    with pytest.raises(Exception, match="does not fit"):
        embedded(rows, "k", "t", lambda texts: [[1.0]], width=1).collect()


@pytest.mark.parametrize(("mark", "kept", "right"), [("9" * 19, "9" * 19, False), ("1" * 40, "1" * 40, False), ("0" * 40 + "3", "3", True), ("0", "0", False), ("3", "3", True), ("4", "4", False), ("9999999999", "9999999999", False)])
def test_numbers_of_any_length_are_judged(spark, mark, kept, right):
    v = one(spark, citations.validation(F.col("t"), F.lit(3), 0.5), t=f"A fact [^1]. Other [^{mark}].")
    assert v["cited"] == sorted(["1", kept], key=lambda x: (len(x), x)) and v["ok"] is right
    assert v["invalid"] == ([] if right else [kept])
    parts = one(spark, citations.text_parts(F.col("t")), t=f"[^1] A[^{mark}]b")
    assert parts == ["[^1]", " A", f"[^{mark}]", "b"]
