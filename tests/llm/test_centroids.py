"""Centroid clustering against rounds over all pairs."""

from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np
import pytest

from loomspark.llm import centroids, registry


def brute_force(rows, k, rounds, d, seed=2):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and len(v) == d and all(x is not None and math.isfinite(x) and abs(256 * x) < 2**26 for x in v)]
    starts = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    c = [v for _, v in starts]
    away = lambda v, w: sum((x - y) ** 2 for x, y in zip(v, w))
    nearest = lambda v: min(range(len(c)), key=lambda j: (away(v, c[j]), j))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v), []).append(v)
        c = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c[j] for j in range(len(c))]
    labels = [nearest(v) for _, v in kept]
    apart = [away(v, c[j]) for (_, v), j in zip(kept, labels)]
    inertia = {j: sum(a for a, x in zip(apart, labels) if x == j) for j in set(labels)}
    digest = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c]
    return sorted((i, j, a, inertia[j], sum(apart), digest[j]) for (i, _), j, a in zip(kept, labels, apart))


def rows_of(df):
    return sorted((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


@pytest.fixture(scope="module")
def odd():
    rng = np.random.default_rng(1)
    rows = [(int(i), (rng.normal(size=4) * rng.choice([0.01, 1, 30])).tolist()) for i in rng.permutation(700)]
    # Few values, so that many distances are equal; copies of one vector; what takes no part.
    rows += [(1000 + i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(300)] + [(2000 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(300)]
    rows += [(5, [0.5, 0.5, 0.5, 0.5]), (5, [0.5, 0.5, 0.5, 0.5]), (5, [0.1, 0.0, 0.0, 0.0]), (None, [0.0] * 4), (9001, None), (9002, [0.0] * 3), (9003, [0.0, 0.0, None, 0.0])]
    return rows + [(9004, [0.0, float("nan"), 0.0, 0.0]), (9005, [float("inf"), 0.0, 0.0, 0.0]), (9006, [1e300, 0.0, 0.0, 0.0]), (9007, [2.0**17, -(2.0**17), 3.0, 0.0]), (9008, [])]


def test_rounds_are_those_over_all_pairs(spark, odd):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in odd], "vec_id long, embedding array<double>, ids string, cluster int").repartition(3)
    for k, rounds in ((1, 2), (7, 0), (7, 4), (40, 3)):
        got = centroids.cluster(df, k=k, rounds=rounds, components=4)
        assert rows_of(got) == brute_force(odd, k, rounds, 4)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256"]


def test_several_trees_and_few_vectors(spark, odd, monkeypatch):
    few = [(i, v) for i, v in odd if v and len(v) == 4][:5]
    df = spark.createDataFrame(few, "vec_id long, embedding array<double>")
    assert rows_of(centroids.cluster(df, k=40, rounds=2, components=4)) == brute_force(few, 40, 2, 4)
    assert centroids.cluster(df.limit(0), components=4).count() == 0
    assert centroids.build_trees(centroids.whole_vectors(spark.createDataFrame(odd, "vec_id long, embedding array<double>"), "vec_id", "embedding", 256.0, 4), 50).count() >= 20


def test_copies_of_one_vector(spark):
    rows = [(i, [0.25, -1.0]) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert rows_of(centroids.cluster(df, k=3, rounds=2, components=2)) == brute_force(rows, 3, 2, 2)


def test_filtering_prunes_clustered_vectors():
    rng = np.random.default_rng(3)
    middles = rng.integers(-3000, 3000, (40, 8))
    points = np.concatenate([m + rng.integers(-60, 60, (200, 8)) for m in middles])
    tree = centroids.KdTree.over(np.arange(len(points)), points)
    search = centroids.Filter(middles)
    every = ((points[:, None, :] - middles[None]) ** 2).sum(axis=2).argmin(axis=1)
    labels = search.labels(tree)
    assert (labels == every[tree.ids]).all()
    assert search.compared < 0.02 * len(points) * len(middles) and search.together > 0.8 * len(points) and search.pruned
    again = centroids.KdTree.unpacked(tree.packed(), 8)
    assert all((getattr(again, f) == getattr(tree, f)).all() for f in centroids.FIELDS)
    counts, sums = np.zeros(40, np.int64), np.zeros((40, 8), np.int64)
    search.totals(again, counts, sums)
    assert (counts == np.bincount(every, minlength=40)).all() and all((sums[c] == points[every == c].sum(axis=0)).all() for c in range(40))


def test_large_components_are_exact():
    rng = np.random.default_rng(4)
    points, c = rng.integers(-(2**26) + 1, 2**26, (300, 64)), rng.integers(-(2**26) + 1, 2**26, (9, 64))
    tree = centroids.KdTree.over(np.arange(300), points)
    away = [[sum((int(x) - int(y)) ** 2 for x, y in zip(p, q)) for q in c] for p in tree.points]
    assert centroids.Filter(c).labels(tree).tolist() == [min(range(9), key=lambda j: (a[j], j)) for a in away]


def test_op11_against_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    rows = rows_of(registry.queries()["op11_kd_tree_filtering"](spark, data))
    assert rows == sorted(con.execute(registry.oracle_sql()["op11_kd_tree_filtering"]).fetchall())
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    assert rows == brute_force(table, 40, 5, 64)
