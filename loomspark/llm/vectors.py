"""Reading vectors, blocks of queries and of rows that meet in tasks, and merging their results.

Rows are put into cells around pivots (a bounded sample), and what is known of a cell, its pivot,
radius, longest vector and number of rows, is one row of a small table. A query first searches
the most promising cell. Its k-th result there bounds what it can still gain, and it is sent
on only to the cells whose bound is as good. Cells are cut into blocks of bounded size, and so
are the queries that come to one: a task holds one block of each, and nothing of either goes
through the driver. Rows are moved once in each of the two rounds, and once more for every
``QUERY_ROWS`` queries that come to their cell.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import cut_lineage, unit_hash

#: Rows of one index block, and of one block of queries.
INDEX_ROWS = 8192
QUERY_ROWS = 16384
#: Most cells, whose table is held by the driver and broadcast.
MOST_CELLS = 1024
#: Sampled vectors for each pivot, which are chosen far from each other.
SAMPLED = 4


def sound_vectors(df: DataFrame, id_column: str, vector: str, allow_zero: bool) -> DataFrame:
    """Rows (vec_id long, vec array<double>) that take part: no null, NaN or infinity.

    Vectors of another length than the most frequent one (the smaller, if two are as
    frequent) and rows without an id that is a whole number take no part either.
    """
    value = F.col("vec")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_column).try_cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    rows = rows.where(F.col("vec_id").isNotNull() & value.isNotNull() & (F.size(value) > 0) & F.coalesce(finite, F.lit(False)))
    if not allow_zero:
        rows = rows.where(F.exists(value, lambda x: x != 0))
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("vec") == (sizes[0]["d"] if sizes else 0))


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, -1)


#: Searches one block: (query ids, queries, row ids, rows) -> (query row, id, score) arrays.
Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


#: The best score that a row of each cell can have with each query, larger being better:
#: (queries, pivots, radii, longest) -> a matrix.
Optimistic = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def farthest(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the rows, each the one farthest from those taken before."""
    taken = [0]
    away = ((x - x[0]) ** 2).sum(axis=1)
    while len(taken) < min(n, len(x)):
        taken.append(int(away.argmax()))
        away = np.minimum(away, ((x - x[taken[-1]]) ** 2).sum(axis=1))
    return x[taken]


class Cells:
    """The cells' pivots, and what they hold."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.radius, self.longest, self.rows = np.zeros(len(pivots)), np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)

    def assigned(self, vectors: DataFrame) -> DataFrame:
        """Rows (vec_id, vec, cell, away, norm): the nearest pivot, the distance from it, the length."""
        pivots = self.pivots
        squares = (pivots**2).sum(axis=1)

        def work(batches):
            for batch in batches:
                x = matrix(batch.column(1), batch.num_rows)
                cell = (squares - 2 * (x @ pivots.T)).argmin(axis=1)
                away = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away), pa.array(np.sqrt((x**2).sum(axis=1)))], ["vec_id", "vec", "cell", "away", "norm"])

        return vectors.select("vec_id", "vec").mapInArrow(work, "vec_id long, vec array<double>, cell int, away double, norm double")

    def measure(self, rows: DataFrame) -> None:
        for r in rows.groupBy("cell").agg(F.max("away").alias("away"), F.max("norm").alias("norm"), F.count(F.lit(1)).alias("n")).collect():
            # Bounds have to hold in spite of rounding.
            self.radius[r["cell"]], self.longest[r["cell"]], self.rows[r["cell"]] = r["away"] * (1 + 1e-9), r["norm"] * (1 + 1e-9), r["n"]


def search_blocks(vectors: DataFrame, queries: DataFrame, search: Search, score_type: str, optimistic: Optimistic, k: int, largest: bool, index_rows: int = INDEX_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The best rows of every query (query_id, rank, vec_id, score), as ``search`` finds them in blocks.

    A repeated query id is one query; of different vectors under one id the smallest counts.
    """
    spark = vectors.sparkSession
    single = cut_lineage(queries.groupBy("vec_id").agg(F.min("vec").alias("vec")))
    n = vectors.count()
    wanted = min(MOST_CELLS, -(-n // index_rows))
    share = min(1.0, 2 * SAMPLED * wanted / max(1, n))
    sample = vectors.where(unit_hash(7, F.col("vec_id")) < share).limit(SAMPLED * wanted).collect() or vectors.limit(wanted).collect()
    if not sample or single.isEmpty():
        return spark.createDataFrame([], f"query_id long, rank int, vec_id long, score {score_type}")
    cells = Cells(farthest(np.unique(np.array([r["vec"] for r in sample], np.float64), axis=0), wanted))
    # Rows are dealt out by their place, so that one frequent id is spread over all blocks.
    rows = cut_lineage(cells.assigned(vectors).withColumn("at", F.monotonically_increasing_id()))
    cells.measure(rows)
    sign = 1.0 if largest else -1.0

    def sent(known: DataFrame, first: bool) -> DataFrame:
        """Queries (vec_id, vec, cell) for the most promising cell, or for all others that can still
        improve on a query's k-th score."""

        def work(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    best = optimistic(matrix(part.column(1), part.num_rows), cells.pivots, cells.radius, cells.longest)
                    best[:, cells.rows == 0] = -np.inf
                    # The first cell has to hold k rows besides the query itself, if there is such a cell.
                    home = np.where(cells.rows > k, best, best - 1e300 if (cells.rows > k).any() else best).argmax(axis=1)
                    if first:
                        query, cell = np.arange(part.num_rows), home
                    else:
                        kth = sign * part.column(2).cast(pa.float64()).fill_null(-sign * np.inf).to_numpy(zero_copy_only=False)
                        open_ = (best + 1e-6 * np.abs(best) + (0.5 if score_type == "long" else 1e-12) >= kth[:, None]) & (cells.rows > 0)
                        open_[np.arange(part.num_rows), home] = False
                        query, cell = np.nonzero(open_)
                    chosen = part.take(pa.array(query))
                    yield pa.RecordBatch.from_arrays([chosen.column(0), chosen.column(1), pa.array(cell.astype(np.int32))], ["vec_id", "vec", "cell"])

        return known.mapInArrow(work, "vec_id long, vec array<double>, cell int")

    def met(asked: DataFrame) -> DataFrame:
        """What the blocks of the cells find for the queries that come to them."""
        asked = cut_lineage(asked)
        coming = np.zeros(len(cells.rows), np.int64)
        for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
            coming[r["cell"]] = r["n"]
        of = lambda counts, size: F.element_at(F.array(*(F.lit(int(-(-c // size))) for c in counts)), F.col("cell") + 1)
        every = lambda parts: F.explode(F.sequence(F.lit(0), parts - 1))
        held, chunks = F.greatest(of(cells.rows, index_rows), F.lit(1)), of(coming, query_rows)
        left = asked.select("cell", F.pmod(F.xxhash64("vec_id"), chunks).cast("int").alias("q"), every(held).alias("d"), "vec_id", "vec")
        place = F.pmod(F.col("at") + F.shiftright("at", 33), held).cast("int").alias("d")
        right = rows.where(chunks > 0).select("cell", every(chunks).alias("q"), place, "vec_id", "vec")
        return left.groupBy("cell", "d", "q").cogroup(right.groupBy("cell", "d", "q")).applyInArrow(work, f"query_id long, vec_id long, score {score_type}")

    arrow = pa.int64() if score_type == "long" else pa.float64()

    def work(asked: pa.Table, held: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not asked.num_rows or not held.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], arrow)], names)
        sides = [t.sort_by("vec_id").combine_chunks() for t in (asked, held)]
        ids, row_ids = (t.column("vec_id").to_numpy() for t in sides)
        block, rows = (matrix(t.column("vec").combine_chunks(), t.num_rows) for t in sides)
        row, found, score = search(ids, block, row_ids, rows)
        return pa.table([pa.array(ids[row]), pa.array(found, pa.int64()), pa.array(score, arrow)], names)

    score = F.col("score").desc() if largest else F.col("score").asc()
    near = cut_lineage(best_of(met(sent(single.withColumn("kth", F.lit(None).cast(score_type)), True)), k, score))
    kth = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    far = met(sent(single.join(kth, "vec_id", "left"), False))
    return best_of(near.drop("rank").unionByName(far), k, score)


def best_of(found: DataFrame, k: int, score: Column) -> DataFrame:
    """The best ``k`` of each query; ties go to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(score, "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
