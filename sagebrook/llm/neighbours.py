"""The most similar vectors for every query vector, from balanced posting lists.

Centroids are fitted on a bounded sample. Every vector is put on the lists of its nearest centroid
and of those nearly as near; lists that hold much are cut into parts of about equal size. A query
finds near centroids by a walk on an in-memory graph, keeps those within a distance ratio of the
nearest, and is compared exactly with all vectors on their lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


SAMPLE = 20_000  # vectors that centroids are fitted on, about
MOST_LISTS = 2048
PART = 2000  # vectors a part of a list, about
PER_LIST = 200
QUERY_PART = 8192  # queries that one task compares with a part, about
REPLICAS = 3
REPLICA_RATIO = 1.12  # of squared distances, up to which a vector also goes on a further list
QUERY_RATIO = 1.8
LEAST_LISTS = 16
QUERY_LISTS = 64
DEGREE = 16
BEAM = 64


def usable(vectors: pd.Series, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors (of `size` finite numbers, not all zero) and their unit forms."""
    right = [i for i, v in enumerate(vectors) if v is not None and not np.isscalar(v) and len(v) == size]
    if not right:
        return np.zeros(0, np.int64), np.zeros((0, size), np.float32)
    x = np.array([vectors.iat[i] for i in right], np.float64)
    norm = np.linalg.norm(x, axis=1)
    ok = np.isfinite(norm) & (norm > 0)
    return np.array(right)[ok], (x[ok] / norm[ok, None]).astype(np.float32)


@dataclass
class Index:
    centroids: np.ndarray
    graph: np.ndarray  # DEGREE nearest centroids of each, those that it is among the nearest of, a few at random; filled up with itself
    entries: np.ndarray
    parts: np.ndarray  # parts of each list
    asked: np.ndarray  # parts of each list's queries

    def lists_of(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For up to REPLICAS lists: the places of the vectors that belong there, and the list."""
        far = 2 - 2 * (x @ self.centroids.T)
        k = min(REPLICAS, far.shape[1])
        near = np.argpartition(far, k - 1, axis=1)[:, :k]
        d = np.take_along_axis(far, near, axis=1)
        order = np.argsort(d, axis=1)
        near, d = np.take_along_axis(near, order, axis=1), np.take_along_axis(d, order, axis=1)
        return [(at, near[at, r]) for r in range(k) for at in [np.flatnonzero(d[:, r] <= np.maximum(d[:, 0], 1e-6) * REPLICA_RATIO)]]

    def walk(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries, BEAM) near centroids and their squared distances, nearest first, by best-first search on the graph."""
        n, c = len(q), len(self.centroids)
        width = min(BEAM, c)
        seen = np.zeros((n, c), bool)
        seen[:, self.entries] = True
        ids = np.repeat(self.entries[None, :], n, axis=0)
        d = 2 - 2 * (q @ self.centroids[self.entries].T)
        opened = np.zeros_like(ids, bool)
        rows = np.arange(n)[:, None]
        while True:
            order = np.argsort(d, axis=1)[:, :width]
            ids, d, opened = (np.take_along_axis(a, order, axis=1) for a in (ids, d, opened))
            todo = np.where(opened | ~np.isfinite(d), np.inf, d)
            if not np.isfinite(todo).any():
                return ids, d
            pick = np.argsort(todo, axis=1)[:, :4]
            live = np.isfinite(np.take_along_axis(todo, pick, axis=1))
            np.put_along_axis(opened, pick, True, axis=1)
            new = self.graph[np.take_along_axis(ids, pick, axis=1)].reshape(n, -1)
            fresh = ~seen[rows, new] & np.repeat(live, self.graph.shape[1], axis=1)
            order = np.argsort(new, axis=1, kind="stable")  # the same neighbour twice counts once
            ordered = np.take_along_axis(new, order, axis=1)
            twice = np.zeros_like(fresh)
            np.put_along_axis(twice, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], axis=1)
            dist = np.where(fresh & ~twice, 2 - 2 * np.einsum("nkd,nd->nk", self.centroids[new], q), np.inf)
            np.logical_or.at(seen, (np.repeat(rows, new.shape[1], axis=1)[fresh], new[fresh]), True)
            ids, d = np.concatenate((ids, new), axis=1), np.concatenate((d, dist), axis=1)
            opened = np.concatenate((opened, np.zeros_like(new, bool)), axis=1)

    def select(self, q: np.ndarray) -> list[np.ndarray]:
        """For each query the lists to search: those within QUERY_RATIO of the nearest, LEAST_LISTS to QUERY_LISTS of them."""
        ids, d = self.walk(q)
        keep = (d <= np.maximum(d[:, :1], 1e-6) * QUERY_RATIO) | (np.arange(d.shape[1]) < LEAST_LISTS)
        keep &= np.isfinite(d) & (np.arange(d.shape[1]) < QUERY_LISTS)
        return [i[k] for i, k in zip(ids, keep)]


def fit_index(sample: np.ndarray, total: int, rounds: int = 8, seed: int = 5, queries: int = 0, exact: bool = False) -> Index:
    """Balanced spherical k-means on the sample: crowded centroids pay for their size when vectors choose. `exact`: one list, in parts, that all queries search."""
    rng = np.random.default_rng(seed)
    n = len(sample)
    lists = 1 if exact else int(max(1, min(MOST_LISTS, n // 8, -(-total // PER_LIST))))
    centroids = sample[rng.choice(n, lists, replace=False)]
    size = np.full(lists, n / lists)
    for _ in range(rounds):
        choice = (sample @ centroids.T - 0.02 * np.log(np.maximum(size, 1) * lists / n)).argmax(axis=1)
        size = np.bincount(choice, minlength=lists).astype(float)
        sums = np.zeros_like(centroids)
        np.add.at(sums, choice, sample)
        empty = size == 0
        sums[empty] = sample[rng.choice(n, int(empty.sum()))]
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    near = centroids @ centroids.T
    np.fill_diagonal(near, 9)
    ranked = np.argsort(-near, axis=1)[:, : DEGREE + 1]
    links = [set(r.tolist()) for r in ranked]
    for i, r in enumerate(ranked):  # a centroid far from all others is reached from those it finds nearest
        for j in r[1:4]:
            links[j].add(i)
        links[i].update(rng.integers(0, lists, 3).tolist())  # a few links at random keep the graph in one piece
    graph = np.repeat(np.arange(lists)[:, None], max(map(len, links)), axis=1)
    for i, own in enumerate(links):
        graph[i, : len(own)] = sorted(own)
    share = np.bincount((sample @ centroids.T).argmax(axis=1), minlength=lists) / n
    parts = np.maximum(1, np.ceil(share * total * 1.5 / PART)).astype(np.int64)
    asked = np.maximum(1, np.ceil(np.minimum(share * LEAST_LISTS * 1.5, 1) * queries / QUERY_PART)).astype(np.int64)
    return Index(centroids.astype(np.float32), graph, rng.choice(lists, min(lists, 32), replace=False), parts, asked)


def _units(rows: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, x = usable(b["vector"], size)
            if len(at):
                yield pd.DataFrame({"id": b["id"].to_numpy()[at], "unit": [v.tobytes() for v in x]})

    return rows.where(F.col("id").isNotNull() & (F.size("vector") == size)).select("id", "vector").mapInPandas(run, "id string, unit binary")


def _matrix(raw: pd.Series, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float32).reshape(-1, size)


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, size: int = 64, exact: bool = False) -> DataFrame:
    """(query_id, neighbour_id, similarity): for each query the k most similar other rows by cosine.

    `rows` and `queries` have id and vector; an id delivered twice counts once. Vectors that are
    null, of another size, all zero or not finite take no part on either side. Ties go to the
    smaller id. Fewer than k usable rows give fewer neighbours; no usable rows give none.
    Every row is on at least one list; the share of true neighbours found is measured in the tests.
    `exact` compares every query with every row, in blocks of PART rows and QUERY_PART queries.
    """
    units = _units(rows, size)
    total = rows.count()
    rate = min(1.0, SAMPLE / max(1, total))
    chosen = units.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(rate * (1 << 20)) + 1)
    got = chosen.orderBy(F.xxhash64("id"), "id").select("unit").limit(3 * SAMPLE).toPandas()["unit"]  # SAMPLE of them but for chance; the same on each run
    schema = "query_id string, neighbour_id string, similarity double"
    if not len(got):
        return rows.sparkSession.createDataFrame([], schema)
    index = fit_index(_matrix(got, size), total, queries=queries.count(), exact=exact)

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b["id"].to_numpy()
            raw = b["unit"].to_numpy()
            spread = pd.util.hash_array(ids.astype(object)).astype(np.uint64)
            for at, lists in index.lists_of(_matrix(b["unit"], size)):
                parts = index.parts[lists].astype(np.uint64)
                if not len(at):
                    continue
                for q in range(int(index.asked[lists].max())):
                    some = index.asked[lists] > q
                    yield pd.DataFrame({"list": lists[some], "part": (spread[at] % parts).astype(np.int64)[some], "asked_part": q, "id": ids[at][some], "unit": raw[at][some]})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 512):
                c = b.iloc[i : i + 512]
                spread = pd.util.hash_array(c["id"].to_numpy().astype(object)).astype(np.uint64)
                out = [(int(x), p, int(h % np.uint64(index.asked[x])), key, raw) for key, raw, h, lists in zip(c["id"], c["unit"], spread, index.select(_matrix(c["unit"], size))) for x in lists for p in range(int(index.parts[x]))]
                if out:
                    yield pd.DataFrame(out, columns=["list", "part", "asked_part", "id", "unit"])

    def compare(both: pd.DataFrame) -> pd.DataFrame:
        posted, asked = both[~both["asked"]].drop_duplicates(["id", "unit"]).sort_values("id"), both[both["asked"]]
        if not len(posted) or not len(asked):
            return pd.DataFrame({"query_id": [], "neighbour_id": [], "similarity": []}).astype({"query_id": object, "neighbour_id": object})
        x = _matrix(posted["unit"], size).astype(np.float64)
        ids, out = posted["id"].to_numpy(), []
        asked = asked.drop_duplicates("id")
        for i in range(0, len(asked), 1024):
            part = asked.iloc[i : i + 1024]
            near = np.round(_matrix(part["unit"], size).astype(np.float64) @ x.T, 12)  # equal vectors may differ in the last bits
            keep = min(2 * k + 2, near.shape[1])  # an id with two vectors and the query itself take places
            top = np.argpartition(-near, keep - 1, axis=1)[:, :keep]
            floor = np.take_along_axis(near, top, axis=1).min(axis=1)
            for key, row, low in zip(part["id"], near, floor):
                t = np.concatenate((np.flatnonzero(row > low), np.flatnonzero(row == low)[:keep]))  # of equal ones the smallest ids
                out.append(pd.DataFrame({"query_id": key, "neighbour_id": ids[t], "similarity": row[t]}))
        done = pd.concat(out, ignore_index=True)
        return done[done["query_id"] != done["neighbour_id"]].drop_duplicates(["query_id", "neighbour_id"])

    posted = units.mapInPandas(post, "list long, part long, asked_part long, id string, unit binary").withColumn("asked", F.lit(False))
    asked = _units(queries, size).mapInPandas(ask, "list long, part long, asked_part long, id string, unit binary").withColumn("asked", F.lit(True))
    found = posted.unionByName(asked).groupBy("list", "part", "asked_part").applyInPandas(compare, schema)
    best = found.groupBy("query_id", "neighbour_id").agg(F.max("similarity").alias("similarity"))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbour_id")
    return best.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")
