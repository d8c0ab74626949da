"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Codes are the signs of centred vectors under learned rotations (iterative quantization: a
rotation is alternately fitted to the signs it gives). A code is split into substrings of
sixteen bits, each indexed by a table from its value to the rows that have it. Two codes
within Hamming distance ``r`` agree in some substring up to a threshold, where the thresholds
add up to ``r`` less the number of substrings plus one (pigeonhole); probing all values
within the thresholds therefore retrieves every code within the radius, whose rows are then
ranked by their true distance. A code is read once a query, however many substrings list it.

A query's radius follows its own neighbours: it starts small, grows until ``k`` rows are found,
and ends at the radius that, on the sample, holds ``REACH`` of the pairs as near as the
``k``-th row found. Rotations and that relation are fitted on a bounded sample; all rows are
indexed, in blocks that meet blocks of queries (see ``vectors``).

Defined cases: rows without id, vectors null, zero, of another length or with null or
non-finite components take no part; ties go to the smaller id; repeated rows are candidates
of their own, a repeated query id is one query; other columns play no part; without queries,
and for an empty table, the result is empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import read_table, unit_hash
from loomspark.llm.vectors import search_blocks, sound_vectors

#: Bound of the sample that rotations and radius are fitted on.
SAMPLE_ROWS = 4096
ROTATIONS = 2
#: Part of the sample's pairs of a distance that the radius for it has to hold.
REACH = 0.95
BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: The same for substrings.
SUBSTRING_BITS = BITS[np.arange(1 << 16) & 255] + BITS[np.arange(1 << 16) >> 8]


class Hasher:
    """Centre and rotations; codes are packed eight bits a byte, in whole substrings."""

    def __init__(self, sample: np.ndarray, k: int, rotations: int = ROTATIONS, steps: int = 30, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.centre = sample.mean(axis=0)
        x = sample - self.centre
        d = x.shape[1]
        self.rotations = []
        for _ in range(rotations):
            r = np.linalg.qr(rng.normal(size=(d, d)))[0]
            for _ in range(steps):
                u, _, v = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x)
                r = (u @ v).T
            self.rotations.append(r)
        self.start, self.edges, self.radii = self._fit_radii(sample, k)

    def codes(self, x: np.ndarray) -> np.ndarray:
        x = x - self.centre
        packed = np.packbits(np.concatenate([x @ r >= 0 for r in self.rotations], axis=1), axis=1)
        return np.pad(packed, ((0, 0), (0, packed.shape[1] % 2)))

    def _fit_radii(self, sample: np.ndarray, k: int, classes: int = 24) -> tuple[int, np.ndarray, np.ndarray]:
        """A radius to begin with, and upper ends of classes of distances with the radius for each."""
        codes = self.codes(sample)
        bits, firsts, pairs = 8 * codes.shape[1], [], []
        for i in range(min(256, len(sample))):
            distance = np.sqrt(((sample - sample[i]) ** 2).sum(axis=1))
            near = np.argsort(distance, kind="stable")[1 : 4 * k + 1]
            apart = BITS[codes[near] ^ codes[i]].sum(axis=1, dtype=np.int64)
            firsts += apart[:k].tolist()
            pairs.append(np.stack([distance[near], apart]))
        distance, apart = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0))
        if len(distance) < 10 * classes:
            return bits, np.zeros(0), np.full(1, bits)
        order = np.argsort(distance, kind="stable")
        parts = np.array_split(order, classes)
        radii = np.maximum.accumulate([int(np.quantile(apart[p], REACH)) for p in parts])
        return int(np.quantile(firsts, 0.05)), np.array([distance[p].max() for p in parts]), np.append(radii, bits)

    def radius(self, distance: float) -> int:
        """The radius for rows up to a distance."""
        return int(self.radii[np.searchsorted(self.edges, distance, "left")])


class CodeIndex:
    """A table for each substring of the codes: rows in the order of its value."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.probed = codes, 0
        substrings = np.ascontiguousarray(codes).view(np.uint16).T
        self.order = [np.argsort(c, kind="stable") for c in substrings]
        self.starts = [np.searchsorted(c[o], np.arange((1 << 16) + 1)) for c, o in zip(substrings, self.order)]

    def apart(self, code: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Hamming distances of rows from a code; ``probed`` counts the rows whose codes are read."""
        codes = self.codes[rows]
        self.probed += len(codes)
        return BITS[codes ^ code].sum(axis=1, dtype=np.int64)

    def listed(self, code: np.ndarray, radius: int) -> np.ndarray:
        """The rows that some substring lists within its threshold (a mask): all rows within the
        radius are among them."""
        parts = np.ascontiguousarray(code).view(np.uint16)
        m = len(parts)
        thresholds = np.full(m, (radius - m + 1) // m)
        thresholds[: (radius - m + 1) % m] += 1
        met = np.zeros(len(self.codes), bool)
        for j in np.flatnonzero(thresholds >= 0):
            values = np.flatnonzero(SUBSTRING_BITS[np.arange(1 << 16) ^ parts[j]] <= thresholds[j])
            begins, sizes = self.starts[j][values], self.starts[j][values + 1] - self.starts[j][values]
            shift = np.repeat(begins - np.cumsum(sizes) + sizes, sizes)
            met[self.order[j][shift + np.arange(len(shift))]] = True
        return met

    def within(self, code: np.ndarray, radius: int, known: np.ndarray | None = None) -> np.ndarray:
        """All rows within the radius of a code. ``known`` holds the distances that earlier calls for
        this code have read (-1 for none), and takes those of this one."""
        known = np.full(len(self.codes), -1) if known is None else known
        new = np.flatnonzero(self.listed(code, radius) & (known < 0))
        known[new] = self.apart(code, new)
        return np.flatnonzero((known >= 0) & (known <= radius))

    def search(self, hasher: Hasher, code: np.ndarray, query: np.ndarray, rows: np.ndarray, others: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows found for a query, among ``others``, and their distances."""
        bits, radius, wanted = 8 * len(code), hasher.start, min(k, int(others.sum()))
        known = np.full(len(self.codes), -1)
        while True:
            found = self.within(code, radius, known)
            found = found[others[found]]
            score = np.sqrt(((rows[found] - query) ** 2).sum(axis=1))
            if radius >= bits:
                return found, score
            if len(found) >= wanted:
                needed = hasher.radius(float(np.partition(score, wanted - 1)[wanted - 1])) if wanted else 0
                if needed <= radius:
                    return found, score
                radius = needed
            else:
                radius = min(bits, radius + max(4, radius // 4))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, sample_rows: int = SAMPLE_ROWS, **blocks: int) -> DataFrame:
    """The ``k`` nearest rows found for each query, by Euclidean distance, itself excluded;
    ``blocks`` are sizes for ``search_blocks``."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n = vectors.count()
    share = min(1.0, sample_rows / max(1, n))
    sample = vectors.where(unit_hash(3, F.col("vec_id")) < share).orderBy("vec_id").limit(2 * sample_rows).collect() or vectors.limit(sample_rows).collect()
    if not sample:
        return empty
    hasher = Hasher(np.array([r["vec"] for r in sample], np.float64), k)

    def search(ids, block, row_ids, rows):
        index, codes = CodeIndex(hasher.codes(rows)), hasher.codes(block)
        out = []
        for q, (code, own) in enumerate(zip(codes, ids)):
            found, score = index.search(hasher, code, block[q], rows, row_ids != own, k)
            best = np.lexsort((row_ids[found], score))[:k]
            out.append((np.full(len(best), q), row_ids[found[best]], score[best]))
        return tuple(np.concatenate(c) for c in zip(*out))

    def optimistic(queries, pivots, radius, longest):
        long, other = (queries**2).sum(axis=1)[:, None], (pivots**2).sum(axis=1)
        # What rounding can take from a difference of squares is left out of the distance.
        away = np.sqrt(np.maximum(long + other - 2 * (queries @ pivots.T), 0.0)) - 1e-7 * np.sqrt(long + other)
        return -np.maximum(away - radius, 0.0)

    return search_blocks(vectors, queries, search, "double", optimistic, k, False, **blocks)


def op2_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = sound_vectors(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", allow_zero=False)
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)
