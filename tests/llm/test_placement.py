"""Shards and vector searches against brute force."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import dual_tree, multi_index_hashing, registry, sharding
from loomspark.llm.vectors import search_blocks, sound_vectors


def check_shards(rows, texts, shards, spread):
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in rows) == sorted((i is None, i) for i, _ in texts)
    sizes = [0] * shards
    slots = [[] for _ in range(shards)]
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(sizes) - min(sizes) <= spread
    return sizes


def test_op1_balances_bytes(spark):
    data = "/root/testdata/sf0.01"
    texts = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    rows = registry.queries()["op1_sampled_splitters"](spark, data).collect()
    largest = max(len((t or "").encode()) + 8 for _, t in texts)
    check_shards(rows, texts, 24, 2 * largest)
    by_id = {i: t for i, t in texts}
    for r in rows:
        content = (by_id[r["doc_id"]] or "").encode()
        assert r["size"] == len(content) + 8 and r["text_crc32"] == zlib.crc32(content) and r["law"] == "bytes" and r["grown_shard"] is None


def test_shards_cut_a_hot_group(spark):
    texts = [(i, "the same text") for i in range(3000)] + [(10_000 + i, f"text {i} " * (i % 7)) for i in range(3000)] + [(None, None), (5, ""), (7, "the same text")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("shard", F.lit("mine")).repartition(5)
    rows = sharding.shard_documents(df, 8).collect()
    check_shards(rows, texts, 8, 200)
    assert len({r["shard"] for r in rows if r["size"] == 21}) > 1
    assert sharding.shard_documents(df.limit(0), 8).count() == 0


def test_one_key_only(spark):
    df = spark.createDataFrame([(1, "x")] * 500, "doc_id long, text string")
    rows = sharding.shard_documents(df, 4).collect()
    check_shards(rows, [(1, "x")] * 500, 4, 9)


def test_shards_are_written_whole(spark, tmp_path):
    texts = [(i, f"t{i}") for i in range(50)] + [(7, "again"), (7, "t7"), (None, "no id"), (None, None)]
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, slot string")
    sharding.write_shards(df, 3, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.select("doc_id", "text", "slot").collect())) == sorted(map(str, df.select("doc_id", "text", "slot").collect()))
    mine = df.withColumn("shard", F.lit("mine")).withColumn("held_0", F.lit(1))
    sharding.write_shards(mine, 3, str(tmp_path / "named"))
    again = spark.read.parquet(str(tmp_path / "named"))
    assert sorted(again.columns) == sorted([*mine.columns, "shard_1"]) and {r[0] for r in again.select("shard").collect()} == {"mine"}
    assert sorted(r[0] for r in again.select("shard_1").distinct().collect()) == [0, 1, 2]
    assert sorted(r[0] for r in back.select("shard").distinct().collect()) == [0, 1, 2]


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([(f"doc-{i}", "x" * i) for i in range(30)] + [("", ""), (None, "y")], "doc_id string, text string")
    assert sharding.shard_documents(df, 3).count() == 32


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 16))
    x[200:260] = x[0]
    x[300:340] = x[1] + rng.normal(size=(40, 16)) * 0.01
    rows = [(int(i), [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]
    odd = [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [None] * 16), (2005, [float("inf")] * 16), (2006, [1.0]), (None, rows[0][1])]
    return rows, spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).repartition(3)


def test_unsound_vectors_take_no_part(vectors):
    rows, df = vectors
    assert sound_vectors(df, "vec_id", "embedding", allow_zero=False).count() == len(rows)
    assert sound_vectors(df, "vec_id", "embedding", allow_zero=True).count() == len(rows) + 1


def test_ids_that_are_no_numbers_take_no_part(spark):
    df = spark.createDataFrame([(str(i), [float(i), 1.0]) for i in range(8)] + [("x", [0.0, 1.0]), (None, [0.0, 1.0])], "vec_id string, embedding array<double>")
    for allow_zero in (True, False):
        kept = sound_vectors(df, "vec_id", "embedding", allow_zero=allow_zero)
        assert sorted(r["vec_id"] for r in kept.collect()) == list(range(8))


def test_nearest_neighbours(vectors):
    rows, df = vectors
    v = sound_vectors(df, "vec_id", "embedding", allow_zero=False)
    got = multi_index_hashing.nearest(v, v.where("vec_id % 100 = 0"), 10).collect()
    x = np.array([r[1] for r in rows])
    hits = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(d)), d))[:10]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11)) and [r["score"] for r in mine] == sorted(r["score"] for r in mine)
        assert all(abs(r["score"] - d[r["vec_id"]]) < 1e-12 for r in mine)
        hits += len({r["vec_id"] for r in mine} & set(want.tolist()))
    assert hits >= 0.9 * 150
    ties = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 200), key=lambda r: r["rank"])]
    assert ties == [0, *range(201, 210)]


def test_few_candidates_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, vec array<double>")
    got = multi_index_hashing.nearest(df, df.where("vec_id = 0"), 10).collect()
    assert [(r["vec_id"], r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2), (2, 1)][::-1]
    assert multi_index_hashing.nearest(df, df.limit(0), 10).count() == 0 and multi_index_hashing.nearest(df.limit(0), df.limit(0), 10).count() == 0
    assert dual_tree.top_products(df, df.limit(0), 5).count() == 0
    assert len(dual_tree.top_products(df, df.where("vec_id = 0"), 5).collect()) == 2


def test_pigeonhole_retrieves_everything_in_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 256, (3000, 8)).astype(np.uint8)
    index = multi_index_hashing.CodeIndex(codes)
    for radius in (0, 3, 7, 8, 15, 22, 30, 64):
        code = codes[radius]
        want = np.flatnonzero(multi_index_hashing.BITS[codes ^ code].sum(axis=1) <= radius)
        found = index.within(code, radius)
        # Beyond, probing would list every row, and all codes are compared instead.
        assert radius >= 15 if found is None else found.tolist() == want.tolist()
        assert np.flatnonzero(index.apart(code) <= radius).tolist() == want.tolist()


def test_top_products_are_exact(vectors):
    rows, df = vectors
    v = sound_vectors(df, "vec_id", "embedding", allow_zero=True).where("vec_id < 2000").withColumn("vec", F.transform("vec", lambda x: F.floor(F.lit(256.0) * x).cast("double")))
    got = dual_tree.top_products(v, v.where("vec_id % 50 = 0"), 5).collect()
    x = np.floor(256 * np.array([r[1] for r in rows])).astype(np.int64)
    for q in range(0, 1500, 50):
        s = x @ x[q]
        s[q] = -(10**15)
        want = np.lexsort((np.arange(len(s)), -s))[:5]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [(r["vec_id"], r["score"]) for r in mine] == [(int(i), int(s[i])) for i in want]


def test_cover_tree_holds_its_points():
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(400, 5)), np.repeat(rng.normal(size=(1, 5)), 100, axis=0)])
    tree = dual_tree.cover_tree(x, np.arange(len(x)), 0)

    def points(node):
        held = node.points if node.points is not None else np.concatenate([points(c) for c in node.children])
        assert np.sqrt(((x[held] - node.centre) ** 2).sum(axis=1)).max() <= node.radius + 1e-9
        return held

    assert sorted(points(tree).tolist()) == list(range(len(x)))


def test_blocks_do_not_change_results(vectors):
    rows, df = vectors
    v = sound_vectors(df, "vec_id", "embedding", allow_zero=True).where("vec_id < 2000").withColumn("vec", F.transform("vec", lambda x: F.floor(F.lit(256.0) * x).cast("double")))
    one = sorted(map(tuple, dual_tree.top_products(v, v.where("vec_id % 50 = 0"), 5).collect()))
    assert one == sorted(map(tuple, dual_tree.top_products(v, v.where("vec_id % 50 = 0"), 5, index_rows=200, query_rows=7).collect()))
    w = sound_vectors(df, "vec_id", "embedding", allow_zero=False)
    small = multi_index_hashing.nearest(w, w.where("vec_id % 100 = 0"), 10, index_rows=400, query_rows=4).collect()
    assert len(small) == 150 and all(r["rank"] <= 10 for r in small)


def clustered(rng, clusters=40, each=60, d=32):
    centres = rng.normal(size=(clusters, d))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    return np.repeat(centres, each, axis=0) * 10 + rng.normal(size=(clusters * each, d)) * 0.1


def test_trees_prune_where_vectors_are_clustered():
    x = np.floor(256 * clustered(np.random.default_rng(3))).astype(np.int64)
    ids = np.arange(len(x))
    search = dual_tree.Search(x[::20], ids[::20], x, ids, 5)
    search.visit(dual_tree.cover_tree(x[::20].astype(float), np.arange(len(x[::20])), 0), dual_tree.cover_tree(x.astype(float), ids, 0))
    assert search.compared <= 0.2 * len(x) * len(x[::20])
    for q, i in enumerate(ids[::20]):
        s = x @ x[i]
        s[i] = np.iinfo(np.int64).min
        want = np.lexsort((ids, ~s))[:5]
        assert sorted(zip((-search.score[q]).tolist(), search.found[q].tolist())) == [(-int(s[w]), int(w)) for w in want]


def test_whole_numbers_beyond_doubles():
    rng = np.random.default_rng(5)
    x = rng.integers(-(2**28), 2**28, (300, 8))
    ids = np.arange(300)
    search = dual_tree.Search(x, ids, x, ids, 3)
    assert search.kind is np.int64
    search.visit(dual_tree.cover_tree(x.astype(float), ids, 0), dual_tree.cover_tree(x.astype(float), ids, 0))
    for i in ids:
        s = [(-sum(int(a) * int(b) for a, b in zip(x[i], x[j])), int(j)) for j in ids if j != i]
        assert sorted(zip((-search.score[i]).tolist(), search.found[i].tolist())) == sorted(s)[:3]


def test_probing_is_selective_where_vectors_are_clustered():
    rng = np.random.default_rng(4)
    x = clustered(rng)
    hasher = multi_index_hashing.Hasher(x[rng.permutation(len(x))[:1000]], 10)
    index, hits = multi_index_hashing.CodeIndex(hasher.codes(x)), 0
    queries = range(0, len(x), 48)
    for q in queries:
        others = np.arange(len(x)) != q
        found, _ = index.search(hasher, index.codes[q], x[q], x, others, 10)
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10].tolist()) & set(found.tolist()))
    assert hits >= 0.95 * 10 * len(queries) and index.probed <= 0.25 * len(x) * len(queries)


def test_queries_meet_only_cells_that_can_improve(spark):
    rng = np.random.default_rng(9)
    x = clustered(rng, clusters=30, each=100, d=16)
    order = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), x[j].tolist()) for i, j in enumerate(order)], "vec_id long, vec array<double>").repartition(4)
    pairs = spark.sparkContext.accumulator(0)

    def search(ids, block, row_ids, rows):
        pairs.add(len(ids) * len(row_ids))
        score = ((block[:, None, :] - rows[None]) ** 2).sum(axis=2) ** 0.5
        score[ids[:, None] == row_ids[None]] = np.inf
        best = np.argsort(score, axis=1, kind="stable")[:, :5]
        kept = np.isfinite(np.take_along_axis(score, best, axis=1))
        return np.nonzero(kept)[0], row_ids[best[kept]], np.take_along_axis(score, best, axis=1)[kept]

    def optimistic(queries, pivots, radius, longest):
        return -np.maximum(np.sqrt(((queries[:, None, :] - pivots[None]) ** 2).sum(axis=2)) - radius, 0.0)

    got = search_blocks(df, df.where("vec_id % 20 = 0"), search, "double", optimistic, 5, False, index_rows=100, query_rows=40).collect()
    assert pairs.value <= 0.25 * 3000 * 150
    for q in range(0, 3000, 20):
        d = ((x[order] - x[order[q]]) ** 2).sum(axis=1) ** 0.5
        d[q] = np.inf
        want = np.lexsort((np.arange(3000), d))[:5]
        assert sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q) == [(i + 1, int(w)) for i, w in enumerate(want)]


def test_codes_are_read_once(spark):
    rng = np.random.default_rng(10)
    codes = rng.integers(0, 256, (2000, 8)).astype(np.uint8)
    index, known = multi_index_hashing.CodeIndex(codes), np.full(2000, -1)
    for radius in (3, 10, 20, 28, 64):
        want = np.flatnonzero(multi_index_hashing.BITS[codes ^ codes[5]].sum(axis=1) <= radius)
        assert index.within(codes[5], radius, known).tolist() == want.tolist()
    assert index.probed == 2000


def table_vectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)


def test_op2_on_the_table(spark):
    data = "/root/testdata/sf0.01"
    ids, x = table_vectors(spark, data)
    got = registry.queries()["op2_multi_index_hashing"](spark, data).collect()
    hits, queries = 0, [i for i in ids.tolist() if i % 100 == 0]
    for q in queries:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        want = set(ids[np.lexsort((ids, d))[:10]].tolist())
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert len(mine) == 10 and all(abs(r["score"] - d[ids == r["vec_id"]][0]) < 1e-12 for r in mine)
        hits += len(want & {r["vec_id"] for r in mine})
    assert hits >= 0.9 * 10 * len(queries) and len(got) == 10 * len(queries)


def test_op4_on_the_table(spark):
    data = "/root/testdata/sf0.01"
    ids, x = table_vectors(spark, data)
    x = np.floor(256 * x).astype(np.int64)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in registry.queries()["op4_dual_tree_top_products"](spark, data).collect()}
    want = {}
    for q in ids[ids % 50 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = np.iinfo(np.int64).min
        want |= {(int(q), rank + 1): (int(ids[w]), int(s[w])) for rank, w in enumerate(np.lexsort((ids, ~s))[:5])}
    assert got == want
