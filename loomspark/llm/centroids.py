"""Centroid clustering by filtering centroids through kd-trees.

Every partition builds kd-trees over blocks of its vectors, once. A node holds the number of its
vectors, their exact sums and their bounding box. A round sends the centroids (a table whose
size is given by parameters) down each tree: the centroid nearest to a box's middle is compared
with each other one at the corner of the box that favours the other most, and an other that is
strictly farther even there is farther from every vector in the box and goes. A node with
one centroid left is assigned as a whole, by its count and sums; a leaf with several is
resolved vector by vector. Partitions add up what their trees give each centroid, so a round
shuffles one number a centroid, component and task. Trees are written to the shared folder: a
round reads them again, and losing executors loses nothing.

Everything is in whole numbers and exact: components are floor(``scale`` times the value), and a new
centroid is the floor of its vectors' means. Ties go to the smaller centroid; a centroid without
vectors stays where it is.

Defined cases: rows without an id that is a whole number, vectors null, of another length, with null or non-finite
components or with a component of 2^26 or more take no part (so that squared distances fit 64
bits); an inertia beyond 64 bits is null; repeated rows and repeated ids are vectors of their
own; with fewer vectors than centroids each vector starts one; an empty table gives no rows;
other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import cut_lineage, frugal, read_table, small_batches, written

#: Vectors of one tree, and of a leaf.
TREE_ROWS, LEAF_ROWS = 8192, 24
#: Components have to be smaller than this.
COMPONENT_LIMIT = 1 << 26
LONG_LIMIT = 1 << 63


def whole_vectors(df: DataFrame, id_column: str, vector: str, scale: float, components: int) -> DataFrame:
    """Rows (vec_id long, vec array<long>) that take part."""
    value = F.col("vec")
    sound = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(F.lit(scale) * x) < float(COMPONENT_LIMIT)))
    rows = df.select(F.col(id_column).try_cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size(value) == components) & F.coalesce(sound, F.lit(False)))
    return rows.select("vec_id", F.transform("vec", lambda x: F.floor(F.lit(scale) * x).cast("long")).alias("vec"))


@dataclass
class KdTree:
    """Nodes in preorder: the left child of node ``i`` is ``i + 1``, the right one ``right[i]`` (-1 for
    a leaf); node ``i`` holds the points ``begin[i]`` to ``end[i]``."""

    ids: np.ndarray
    points: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    right: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray

    @staticmethod
    def over(ids: np.ndarray, points: np.ndarray, leaf: int = LEAF_ROWS) -> KdTree:
        order = np.arange(len(points))
        begin, end, right, low, high, sums = [], [], [], [], [], []
        waiting = [(0, len(points), -1)]
        while waiting:
            a, b, parent = waiting.pop()
            if parent >= 0:
                right[parent] = len(begin)
            mine = points[order[a:b]]
            low.append(mine.min(axis=0))
            high.append(mine.max(axis=0))
            sums.append(mine.sum(axis=0))
            begin.append(a)
            end.append(b)
            right.append(-1)
            width = high[-1] - low[-1]
            widest = int(width.argmax())
            if b - a > leaf and width[widest] > 0:
                middle = (a + b) // 2
                order[a:b] = order[a:b][np.argpartition(mine[:, widest], middle - a)]
                # The left half comes first, so that it is the next node.
                waiting += [(middle, b, len(begin) - 1), (a, middle, -1)]
        whole = lambda x: np.array(x, np.int64)
        return KdTree(ids[order], points[order], whole(begin), whole(end), whole(right), whole(low), whole(high), whole(sums))

    def packed(self) -> list[bytes]:
        """Points and boxes fit 32 bits."""
        kinds = ("<i8", "<i4", "<i4", "<i4", "<i4", "<i4", "<i4", "<i8")
        return [getattr(self, name).astype(kind).tobytes() for name, kind in zip(FIELDS, kinds)]

    @staticmethod
    def unpacked(parts: list[bytes], components: int) -> KdTree:
        ids, points, begin, end, right, low, high, sums = (np.frombuffer(p, k).astype(np.int64) for p, k in zip(parts, ("<i8", *["<i4"] * 6, "<i8")))
        table = lambda x: x.reshape(-1, components)
        return KdTree(ids, table(points), begin, end, right, table(low), table(high), table(sums))


FIELDS = ("ids", "points", "begin", "end", "right", "low", "high", "sums")


class Filter:
    """Centroids going down a tree: ``whole`` is called with (node, centroid) and ``resolved`` with
    (node, centroid of each point). ``visited``, ``pruned`` and ``compared`` count what was done."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids.astype(np.int64)
        self.norms = (self.centroids**2).sum(axis=1)
        self.visited = self.pruned = self.compared = self.together = 0

    def undominated(self, tree: KdTree, node: int, left: np.ndarray) -> np.ndarray:
        """The centroids that may be nearest to a point of the node's box."""
        low, high, c = tree.low[node], tree.high[node], self.centroids[left]
        nearest = c[((2 * c - (low + high)) ** 2).sum(axis=1).argmin()]
        corner = np.where(c > nearest, high, low)
        # |c - corner|^2 - |nearest - corner|^2
        farther = ((c - nearest) * (c + nearest - 2 * corner)).sum(axis=1) > 0
        self.pruned += int(farther.sum())
        return left[~farther]

    def nearest(self, points: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The nearest of the centroids for each point, the smaller number of equals."""
        self.compared += len(points) * len(left)
        c = self.centroids[left]
        largest = max(int(np.abs(points).max(initial=0)), int(np.abs(c).max(initial=0)))
        # Products of doubles are exact and quicker while sums stay below 2^53.
        kind = np.float64 if 4 * points.shape[1] * largest**2 < 1 << 53 else np.int64
        return left[(self.norms[left].astype(kind) - 2 * (points.astype(kind) @ c.T.astype(kind))).argmin(axis=1)]

    def run(self, tree: KdTree, whole, resolved) -> None:
        waiting = [(0, np.arange(len(self.centroids)))] if len(tree.begin) and len(self.centroids) else []
        while waiting:
            node, left = waiting.pop()
            self.visited += 1
            if len(left) > 1:
                left = self.undominated(tree, node, left)
            if len(left) == 1:
                self.together += int(tree.end[node] - tree.begin[node])
                whole(node, int(left[0]))
            elif tree.right[node] < 0:
                resolved(node, self.nearest(tree.points[tree.begin[node] : tree.end[node]], left))
            else:
                waiting += [(int(tree.right[node]), left), (node + 1, left)]

    def totals(self, tree: KdTree, counts: np.ndarray, sums: np.ndarray) -> None:
        """Add each centroid's number of points and their sums."""

        def whole(node: int, c: int) -> None:
            counts[c] += tree.end[node] - tree.begin[node]
            sums[c] += tree.sums[node]

        def resolved(node: int, chosen: np.ndarray) -> None:
            points = tree.points[tree.begin[node] : tree.end[node]]
            for c in np.unique(chosen).tolist():
                mine = chosen == c
                counts[c] += mine.sum()
                sums[c] += points[mine].sum(axis=0)

        self.run(tree, whole, resolved)

    def labels(self, tree: KdTree) -> np.ndarray:
        out = np.zeros(len(tree.points), np.int64)

        def assign(node: int, c) -> None:
            out[tree.begin[node] : tree.end[node]] = c

        self.run(tree, assign, assign)
        return out


def build_trees(vectors: DataFrame, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Rows of one tree each, over blocks of a partition's vectors."""
    schema = ", ".join(f"{name} binary" for name in FIELDS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            tree = KdTree.over(np.concatenate(ids), np.concatenate(points))
            return pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in tree.packed()], list(FIELDS))

        ids, points, held = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, tree_rows):
                part = batch.slice(at, tree_rows)
                ids.append(part.column(0).to_numpy())
                points.append(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))
                held += part.num_rows
                if held >= tree_rows:
                    yield rows()
                    ids, points, held = [], [], 0
        if held:
            yield rows()

    return small_batches(vectors).mapInArrow(frugal(work), schema)


def trees_in(batches: Iterator[pa.RecordBatch], components: int) -> Iterator[KdTree]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield KdTree.unpacked([batch.column(name)[i].as_py() for name in FIELDS], components)


def moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, d = centroids.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, search = np.zeros(k, np.int64), np.zeros((k, d), np.int64), Filter(centroids)
        for tree in trees_in(batches, d):
            search.totals(tree, counts, sums)
        some = np.flatnonzero(counts)
        columns = [np.repeat(some, d).astype(np.int32), np.tile(np.arange(d, dtype=np.int32), len(some)), np.repeat(counts[some], d), sums[some].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cluster", "component", "n", "total"])

    parts = trees.mapInArrow(frugal(work), "cluster int, component int, n long, total long")
    # One row a centroid and component, whatever the table: a size given by parameters.
    found = parts.groupBy("cluster", "component").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38, 0)")).alias("total")).collect()
    out = centroids.copy()
    for r in found:
        out[r["cluster"], r["component"]] = int(r["total"]) // r["n"]
    return out


def assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector; the distance is squared."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Filter(centroids)
        for tree in trees_in(batches, centroids.shape[1]):
            label = search.labels(tree)
            distance = ((tree.points - search.centroids[label]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(tree.ids), pa.array(label.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return trees.mapInArrow(frugal(work), "vec_id long, cluster int, distance long")


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors of smallest hash of seed and id; equal ids are in the order of their vectors."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(key.alias("key"), "vec").orderBy("key", "vec").limit(k).collect()
    return np.array([r["vec"] for r in rows], np.int64)


def cluster(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", k: int = 40, rounds: int = 5, components: int = 64, scale: float = 256.0, seed: int = 2) -> DataFrame:
    """One row a vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid (its
    final components) and centroid_sha256."""
    vectors = whole_vectors(df, id_column, vector, scale, components)
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        none = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string"
        return df.sparkSession.createDataFrame([], none)
    trees = written(build_trees(vectors), "trees")
    for _ in range(rounds):
        centroids = moved(trees, centroids)
    rows = cut_lineage(assigned(trees, centroids))
    sums = {r["cluster"]: int(r["n"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38, 0)")).alias("n")).collect()}
    fits = lambda n: n if n < LONG_LIMIT else None
    total = fits(sum(sums.values()))
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    about = [(i, fits(sums.get(i, 0)), total, c, digest(c)) for i, c in enumerate(centroids.tolist())]
    known = df.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    return rows.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")


def op11_kd_tree_filtering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors of 64 components around 40 centroids, after five rounds."""
    return cluster(read_table(spark, sf_dir, "embeddings")).drop("centroid")


def clustering_sql(k: int = 40, rounds: int = 5, components: int = 64, seed: int = 2) -> str:
    """The same by comparing every vector with every centroid, one round after the other."""
    away = "list_sum(list_transform(list_zip(v.vec, c.vec), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT v.i, v.vec_id, v.vec, min(struct_pack(d := CAST({away} AS BIGINT), c := c.c)) AS m FROM v CROSS JOIN c{r} c GROUP BY ALL)")
        if r < rounds:
            steps.append(f"s{r} AS (SELECT m.c AS c, j, sum(vec[j]) AS s, count(*) AS n FROM a{r} CROSS JOIN range(1, {components + 1}) x(j) GROUP BY ALL)")
            steps.append(f"n{r} AS (SELECT c, list(CAST(CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END AS BIGINT) ORDER BY j) AS vec FROM s{r} GROUP BY c)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(n{r}.vec, o.vec) AS vec FROM c{r} o LEFT JOIN n{r} ON n{r}.c = o.c)")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS i, CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = {components} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, vec) - 1 AS c, vec FROM (SELECT sha256('{seed}:' || vec_id) AS h, vec FROM v ORDER BY h, vec LIMIT {k})),
{", ".join(steps)},
t AS (SELECT m.c AS c, sum(m.d) AS n FROM a{rounds} GROUP BY ALL)
SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, m.d AS distance, CAST(t.n AS BIGINT) AS cluster_inertia, CAST((SELECT sum(n) FROM t) AS BIGINT) AS inertia,
  sha256(array_to_string(c.vec, ',')) AS centroid_sha256
FROM a{rounds} a JOIN t ON t.c = m.c JOIN c{rounds} c ON c.c = m.c
"""


OP11_SQL = clustering_sql()
