"""Exact top-k by inner product with a dual-tree search over cover trees.

Queries and data are both indexed by cover trees. A node has a centre among its points and the
radius that its points reach. Its children are a net of it: centres are taken farthest first,
until all points are within half of the node's radius of one (or the most that it may have),
so centres are at least as far apart as any point is from its nearest centre, and each point
belongs to the child of its nearest centre. For a query node and a data node no inner product
exceeds

    min(c_q . c_r + rho_q |c_r| + rho_r |c_q| + rho_q rho_r, longest_q longest_r),

so the pair is pruned when that is below the worst kth score of the query node's queries.
Trees are built over blocks of queries and of rows that meet in tasks. Cells of rows have the same
bound, and a query meets only the cells that can improve on what its first cell gave (see
``vectors``). The exact results of all blocks are merged.

Defined cases: rows without id, vectors null, of another length or with null or non-finite
components take no part; ties go to the smaller id; repeated rows are candidates of their
own, a repeated query id is one query; other columns play no part; scores are computed in
64-bit integers; without queries, and for an empty table, the result is empty.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import read_table
from loomspark.llm.vectors import search_blocks, sound_vectors

#: Points of a node that stays a leaf unless nine tenths as many centres halve its radius, and
#: most children of larger nodes.
LEAF = 512
MOST_CHILDREN = 16


@dataclass
class Node:
    centre: np.ndarray
    norm: float
    radius: float
    longest: float
    points: np.ndarray | None = None
    children: list[Node] = field(default_factory=list)


def cover_tree(x: np.ndarray, members: np.ndarray, centre: int, away: np.ndarray | None = None) -> Node:
    """The tree of the members (rows of ``x``) around a row; ``away`` are their distances from it."""

    def distances(row: int) -> np.ndarray:
        return np.sqrt(((x[members] - x[row]) ** 2).sum(axis=1))

    away = distances(centre) if away is None else away
    radius = float(away.max())
    node = Node(x[centre], float(np.linalg.norm(x[centre])), radius, float(np.sqrt((x[members] ** 2).sum(axis=1).max())))
    if len(members) <= 2 or radius == 0.0:
        node.points = members
        return node
    centres, nearest = [centre], np.zeros(len(members), np.int64)
    most = 9 * len(members) // 10 if len(members) <= LEAF else MOST_CHILDREN
    while away.max() > radius / 2 and len(centres) < most:
        centres.append(int(members[away.argmax()]))
        other = distances(centres[-1])
        closer = other < away
        away, nearest = np.where(closer, other, away), np.where(closer, len(centres) - 1, nearest)
    if len(members) <= LEAF and away.max() > radius / 2:
        node.points = members
        return node
    for i, c in enumerate(centres):
        mine = nearest == i
        node.children.append(cover_tree(x, members[mine], c, away[mine]))
    return node


class Search:
    """The best ``k`` rows of each query, kept while pairs of nodes are visited."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int):
        self.q, self.r = queries, rows
        self.query_ids, self.row_ids, self.k = query_ids, row_ids, k
        self.low, self.compared = np.iinfo(np.int64).min, 0
        self.score = np.full((len(queries), k), self.low)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        exact = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * queries.shape[1] < 2**53
        self.kind = np.float64 if exact else np.int64
        self.qx, self.rx = queries.astype(self.kind), rows.astype(self.kind)

    def worst(self, node: Node) -> float:
        if node.points is not None:
            return self.score[node.points, -1].min()
        return min(self.worst(c) for c in node.children)

    @staticmethod
    def bound(a: Node, b: Node) -> float:
        return min(float(a.centre @ b.centre) + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius, a.longest * b.longest)

    def visit(self, root: Node, data: Node) -> None:
        pairs = [(self.bound(root, data), root, data)]
        while pairs:
            bound, a, b = pairs.pop()
            # A margin for rounding in the bound: scores are whole numbers.
            if bound + 1e-6 * abs(bound) + 0.5 < self.worst(a):
                continue
            if a.points is not None and b.points is not None:
                self.compare(a.points, b.points)
                continue
            if b.points is None and (a.points is not None or b.radius >= a.radius):
                more = [(self.bound(a, c), a, c) for c in b.children]
            else:
                more = [(self.bound(c, b), c, b) for c in a.children]
            pairs += sorted(more, key=lambda p: p[0])

    def compare(self, queries: np.ndarray, rows: np.ndarray) -> None:
        """All scores of two leaves; ``compared`` counts them."""
        self.compared += len(queries) * len(rows)
        rows = rows[np.argsort(self.row_ids[rows], kind="stable")]
        score = (self.qx[queries] @ self.rx[rows].T).astype(np.int64)
        own = self.query_ids[queries][:, None] == self.row_ids[rows][None]
        better = ((score >= self.score[queries, -1][:, None]) & ~own).any(axis=1)
        if not better.any():
            return
        queries, score = queries[better], np.where(own[better], self.low, score[better])
        ids = np.where(own[better], np.iinfo(np.int64).max, self.row_ids[rows][None])
        # Rows are in the order of their ids, so a stable sort leaves ties to the smaller one.
        first = np.argsort(~score, axis=1, kind="stable")[:, : self.k]
        score = np.concatenate([self.score[queries], np.take_along_axis(score, first, axis=1)], axis=1)
        ids = np.concatenate([self.found[queries], np.take_along_axis(ids, first, axis=1)], axis=1)
        best = np.lexsort((ids, ~score), axis=1)[:, : self.k]
        self.score[queries], self.found[queries] = np.take_along_axis(score, best, axis=1), np.take_along_axis(ids, best, axis=1)


def top_products(vectors: DataFrame, queries: DataFrame, k: int, **blocks: int) -> DataFrame:
    """The ``k`` rows of largest inner product for each query, itself excluded.

    Components are whole numbers held as doubles; ``blocks`` are sizes for ``search_blocks``.
    """

    def search(ids, block, row_ids, rows):
        found = Search(block.astype(np.int64), ids, rows.astype(np.int64), row_ids, k)
        found.visit(cover_tree(block, np.arange(len(block)), 0), cover_tree(rows, np.arange(len(rows)), 0))
        row, at = np.nonzero(found.score > found.low)
        return row, found.found[row, at], found.score[row, at]

    def optimistic(queries, pivots, radius, longest):
        length = np.sqrt((queries**2).sum(axis=1))[:, None]
        return np.minimum(queries @ pivots.T + length * radius, length * longest)

    return search_blocks(vectors, queries, search, "long", optimistic, k, True, **blocks)


def op4_dual_tree_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = sound_vectors(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", allow_zero=True)
    vectors = vectors.withColumn("vec", F.transform("vec", lambda x: F.floor(F.lit(256.0) * x).cast("double")))
    return top_products(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


OP4_SQL = """
WITH v AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
d AS (SELECT len(vec) AS d FROM v GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
w AS (SELECT vec_id, vec FROM v WHERE len(vec) = (SELECT d FROM d)),
q AS (SELECT vec_id, min(vec) AS vec FROM w WHERE vec_id % 50 = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, w.vec_id, CAST(list_sum(list_transform(list_zip(q.vec, w.vec), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM q JOIN w ON w.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
