import numpy as np

from sagebrook.llm import neighbours
from sagebrook.llm.neighbours import fit_index, nearest


def vectors(n, seed, size=64):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 40, size))
    return centres[rng.integers(0, len(centres), n)] + 0.8 * rng.normal(size=(n, size))


def test_recall_against_brute_force(spark):
    x = vectors(4000, 1)
    df = spark.createDataFrame([(f"v{i}", v.tolist()) for i, v in enumerate(x)], "id string, vector array<double>")
    queries = df.where("pmod(xxhash64(id), 50) = 0")
    got = {}
    for r in nearest(df, queries).collect():
        got.setdefault(r["query_id"], set()).add(r["neighbour_id"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in got:
        near = u @ u[int(q[1:])]
        near[int(q[1:])] = -2
        hits += len(got[q] & {f"v{i}" for i in np.argsort(-near)[:10]})
    assert len(got) > 50 and all(len(v) == 10 for v in got.values())
    assert hits >= 0.95 * 10 * len(got)


def test_edges(spark):
    one = [1.0] + [0.0] * 63
    data = [("a", one), ("b", [2.0] + [0.0] * 63), ("b", [2.0] + [0.0] * 63), ("c", [0.0, 1.0] + [0.0] * 62), ("z", [0.0] * 64), ("n", None), ("s", [1.0]), ("x", [float("nan")] * 64), (None, one), ("i", [float("inf")] + [0.0] * 63)]
    df = spark.createDataFrame(data, "id string, vector array<double>").selectExpr("*", "1 AS unit", "2 AS part")
    got = {(r["query_id"], r["neighbour_id"]): r["similarity"] for r in nearest(df, df).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "b")}
    assert abs(got["a", "b"] - 1) < 1e-6 and abs(got["a", "c"]) < 1e-6
    assert nearest(df.limit(0), df).count() == 0
    assert nearest(df, df.limit(0)).count() == 0


def test_equal_vectors_are_spread_over_parts(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 50)
    x = np.repeat(vectors(80, 3)[:1], 600, axis=0)
    index = fit_index((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32), 600)
    assert index.parts.max() > 5
    df = spark.createDataFrame([(f"v{i:03}", v.tolist()) for i, v in enumerate(x)], "id string, vector array<double>")
    got = nearest(df, df.where("id < 'v003'"), k=5).collect()
    assert len(got) == 15 and all(abs(r["similarity"] - 1) < 1e-5 for r in got)


def test_walk_finds_near_centroids():
    x = vectors(6000, 4).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = fit_index(x, 200_000)
    q = x[:200]
    ids, _ = index.walk(q)
    best = np.argsort(-(q @ index.centroids.T), axis=1)[:, :8]
    assert np.mean([len(set(a[:8]) & set(b)) / 8 for a, b in zip(ids, best)]) > 0.9


def test_ties_go_to_the_smaller_id_in_groups_of_any_size(spark):
    """2,000 equal vectors: more than fit under any bound on ties, in a part or over several."""
    x = np.repeat(vectors(80, 3)[:1], 2000, axis=0)
    order = np.random.default_rng(1).permutation(len(x))
    df = spark.createDataFrame([(f"v{i:04}", x[i].tolist()) for i in order] + [("w", (x[0] + vectors(80, 5)[0]).tolist())], "id string, vector array<double>")
    got = {}
    for r in nearest(df, df.where("id IN ('v0003', 'v1500', 'w')"), k=5).collect():
        got.setdefault(r["query_id"], set()).add(r["neighbour_id"])
    first = [f"v{i:04}" for i in range(6)]
    assert got == {q: set([i for i in first if i != q][:5]) for q in ("v0003", "v1500", "w")}


def test_exact_search_in_blocks_of_rows_and_queries(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 300)
    monkeypatch.setattr(neighbours, "QUERY_PART", 100)
    x = vectors(1500, 6)
    df = spark.createDataFrame([(f"v{i}", v.tolist()) for i, v in enumerate(x)], "id string, vector array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T
    np.fill_diagonal(near, -2)
    want = {(f"v{i}", f"v{j}") for i, row in enumerate(near) for j in np.argsort(-row)[:5]}
    assert {(r["query_id"], r["neighbour_id"]) for r in nearest(df, df, k=5, exact=True).collect()} == want
    some = {(r["query_id"], r["neighbour_id"]) for r in nearest(df, df, k=5).collect()}  # every vector a query
    assert len(some) == len(want) and len(some & want) >= 0.95 * len(want)
