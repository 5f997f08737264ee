import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sagebrook.llm.mixing import mix_sources, water_fill
from sagebrook.llm.packing import assign, container_use, pack_documents
from sagebrook.llm.tokens import TOKENIZER, encoding

needs_tokenizer = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer")


@given(st.lists(st.integers(1, 100), max_size=80))
@settings(max_examples=60, deadline=None)
def test_no_container_overflows(sizes):
    x = np.array(sizes, np.int64)
    bins = assign(x, 100)
    used = np.bincount(bins, weights=x) if len(x) else np.zeros(0)
    assert (used <= 100).all()


def test_little_room_is_left():
    rng = np.random.default_rng(1)
    x = np.minimum(2000, rng.lognormal(6, 0.9, 4000)).astype(np.int64) + 1
    bins = assign(x, 2048)
    assert x.sum() / ((bins.max() + 1) * 2048) > 0.97


@needs_tokenizer
def test_documents_are_packed_whole(spark):
    random.seed(1)
    texts = [(i, " ".join(random.choice(["dose", "of", "the", "tablet"]) for _ in range(random.choice([3, 40, 90, 700])))) for i in range(120)] + [(900, ""), (901, None), (None, "x"), (902, "dose " * 64)]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS part_no", "2 AS container_id")
    packed = pack_documents(df, 64)
    rows = packed.collect()
    count = {i: len(encoding().encode_ordinary(t)) if t else 0 for i, t in texts if i is not None}
    parts = {}
    for r in rows:
        parts.setdefault(r["doc_id"], []).append((r["part_no"], r["token_start"], r["token_end"], r["n_tokens"]))
    assert set(parts) == set(count)
    for i, p in parts.items():
        p.sort()
        assert p[0][1] == 0 and p[-1][2] == count[i] and all(a[2] == b[1] for a, b in zip(p, p[1:]))
        assert len(p) == 1 or count[i] > 64
    use = container_use(packed, 64).first()
    assert use["fullest"] <= 64 and use["tokens"] == sum(count.values()) and use["share_used"] > 0.85
    assert pack_documents(df.limit(0), 64).count() == 0


def test_water_fill():
    assert water_fill({"a": 0.5, "b": 0.5}, {"a": 100, "b": 100}, 100) == {"a": 50, "b": 50}
    got = water_fill({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 10, "b": 1000, "c": 1000}, 100)
    assert got["a"] == 10 and abs(got["b"] - 54) < 1e-9 and abs(got["c"] - 36) < 1e-9
    assert water_fill({"a": 1.0, "b": 1.0}, {"a": 5, "b": 0}, 100) == {"a": 5, "b": 0}


@needs_tokenizer
def test_mixture_reaches_its_shares(spark):
    rows = [(i, "A-x" if i % 10 < 7 else "b" if i % 10 < 9 else "other", "dose of the tablet " * (1 + i % 5)) for i in range(2000)] + [(9001, "c", "tiny one"), (9002, None, "no source"), (9003, "b", None), (9004, "b", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("repeats", F.lit(5))
    targets = spark.createDataFrame([("a_x", 0.3, 3), ("b", 0.5, 9), ("c", 0.1, 4), ("none", 0.1, 2), (None, 0.5, 2), ("d", None, None)], "source string, target_share double, max_repeats int")
    mixture, report = mix_sources(df, targets, seed=3)
    got = {r["source"]: r for r in report.collect()}
    cap = {"a_x": 3, "b": 9, "c": 4}
    assert all(r["repeats"] <= cap[r["source"]] for r in mixture.collect())
    total = sum(len(encoding().encode_ordinary(t)) for _, _, t in rows if t)
    assert abs(sum(r["tokens"] for r in got.values()) - total) < 100
    assert got["c"]["most_repeats"] == 4 and got["none"]["tokens"] == 0
    assert abs(got["b"]["tokens"] / got["a_x"]["tokens"] - 5 / 3) < 0.02
    again = mix_sources(df, targets, seed=3)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixture.collect()))
    assert mix_sources(df.limit(0), targets)[0].count() == 0
    assert mix_sources(df, targets.limit(0))[0].count() == 0
