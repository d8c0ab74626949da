"""Sharding by sampled splitters: shards of near equal bytes.

Records are ordered by the hash of their text, so equal texts stand together. A sample whose
chance of inclusion is proportional to a record's size gives quantile boundaries of many more
ranges than shards; records are range-partitioned by them, and ranges that turn out to hold
more than twice their share are sampled again and subdivided. A running sum inside each range
then places every record in the global order of bytes, which decides its shard: sizes differ
by about one record, or one group of equal texts of up to ``WHOLE_GROUP`` of a shard. Larger
groups, however large, are cut between shards and between ranges, so no task holds one.

Only the sample and one row a range reach the driver; both depend on the number of ranges.

Defined cases: a null text has no bytes and the hash of an empty text; every record counts 8
bytes more than its text; repeated rows are records of their own, told apart by their place
in the input; a null id is kept, and ids of any type; other columns, whatever their names, play
no part in the placement; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from loomspark.llm.common import cut_lineage, free_names, read_table

#: Ranges for each shard, and sampled records for each range.
RANGES_PER_SHARD = 16
SAMPLE_PER_RANGE = 32
ROWS_PER_RANGE = 2_000_000
#: A group of equal texts up to this part of a shard stays in one shard.
WHOLE_GROUP = 0.01
ROUNDS = 3


class Splitters:
    """Boundaries in the order of (key, tie, row); a range starts at its boundary."""

    def __init__(self, points: list[tuple[int, int, int]]):
        points = sorted(set(points))
        hot = {a[0] for a, b in zip(points, points[1:]) if a[0] == b[0]}
        low = np.iinfo(np.int64).min
        # A boundary alone in its key moves to the key's start, so that a group stays whole.
        self.points = sorted({p if p[0] in hot else (p[0], low, low) for p in points} | {(k, low, low) for k in hot})
        columns = np.array(self.points, np.int64).reshape(-1, 3)
        self.key, self.tie, self.row = columns[:, 0], columns[:, 1], columns[:, 2]

    def locate(self, key: np.ndarray, tie: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The number of boundaries at or before each record."""
        first, after = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        out = after.copy()
        for at in np.unique(first[after - first > 1]):
            mine = np.flatnonzero((first == at) & (after > at + 1))
            end = after[mine[0]]
            ties, rows = self.tie[at:end], self.row[at:end]
            low, high = np.searchsorted(ties, tie[mine], "left"), np.searchsorted(ties, tie[mine], "right")
            for value in np.unique(low[high > low]):
                same = (low == value) & (high > low)
                low[same] += np.searchsorted(rows[value : high[same][0]], row[mine[same]], "right")
            out[mine] = at + low
        return out.astype(np.int32)


def quantiles(sample: pd.DataFrame, ranges: int) -> list[tuple[int, int, int]]:
    """Boundaries that cut a weighted sample into equal parts."""
    if sample.empty:
        return []
    sample = sample.sort_values(["key", "tie", "row"])
    total = sample["weight"].cumsum().to_numpy()
    at = np.searchsorted(total, total[-1] * np.arange(1, ranges) / ranges)
    return list(sample[["key", "tie", "row"]].iloc[np.minimum(at, len(sample) - 1)].itertuples(index=False, name=None))


def draw(rows: DataFrame, wanted: float, total: int, seed: int) -> pd.DataFrame:
    chance = F.least(F.lit(1.0), F.col("size") * (wanted / max(1, total)))
    return rows.where(F.rand(seed) < chance).select("key", "tie", "row", (F.col("size") / chance).alias("weight")).toPandas()


def place(rows: DataFrame, shards: int, ranges_per_shard: int = RANGES_PER_SHARD, sample_per_range: int = SAMPLE_PER_RANGE, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Add ``shard`` and ``slot`` to checkpointed rows with key, tie, row and size (longs)."""
    spark = rows.sparkSession
    sums = rows.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    total, n = sums["bytes"] or 0, sums["n"]
    ranges = max(shards * ranges_per_shard, -(-n // rows_per_range))
    splitters = Splitters(quantiles(draw(rows, ranges * sample_per_range, total, 11), ranges))
    for attempt in range(ROUNDS + 1):
        points = splitters

        @pandas_udf("int")
        def range_of(key: pd.Series, tie: pd.Series, row: pd.Series) -> pd.Series:
            return pd.Series(points.locate(key.to_numpy(np.int64), tie.to_numpy(np.int64), row.to_numpy(np.int64)))

        ranged = rows.withColumn("range", range_of("key", "tie", "row"))
        held = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).orderBy("range").toPandas()
        full = held[((held["bytes"] > 2 * total / ranges) | (held["n"] > 2 * rows_per_range)) & (held["n"] > 1)]
        if full.empty or attempt == ROUNDS:
            break
        parts = F.broadcast(spark.createDataFrame([(int(r),) for r in full["range"]], "range int"))
        inside, size = ranged.join(parts, "range"), int(full["bytes"].sum())
        more = quantiles(draw(inside, sample_per_range * ranges * size / total, size, 12 + attempt), int(2 * ranges * size / total) + 2)
        splitters = Splitters([p for p in points.points if p[1] != np.iinfo(np.int64).min] + [(k, t, r) for k, t, r in points.points if t == np.iinfo(np.int64).min] + more)

    held["base_bytes"] = held["bytes"].cumsum() - held["bytes"]
    held["base_rows"] = held["n"].cumsum() - held["n"]
    plan = [tuple(map(int, r)) for r in held[["range", "base_bytes", "base_rows"]].itertuples(index=False, name=None)]
    bases = F.broadcast(spark.createDataFrame(plan, "range int, base_bytes long, base_rows long"))
    order = Window.partitionBy("range").orderBy("key", "tie", "row")
    group = Window.partitionBy("range", "key")
    share = max(1.0, total / shards)
    placed = (
        ranged.join(bases, "range")
        .withColumn("begin", F.col("base_bytes") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("rank", F.col("base_rows") + F.row_number().over(order) - 1)
        .withColumn("group_size", F.sum("size").over(group))
        .withColumn("group_begin", F.min("begin").over(group))
    )
    whole = F.col("group_size") <= share * WHOLE_GROUP
    middle = F.when(whole, F.col("group_begin") + F.col("group_size") / 2).otherwise(F.col("begin") + F.col("size") / 2)
    placed = placed.withColumn("shard", F.least(F.floor(middle / share), F.lit(shards - 1)).cast("int"))
    placed = cut_lineage(placed.drop("range", "base_bytes", "base_rows", "begin", "group_size", "group_begin"))
    firsts = F.broadcast(placed.groupBy("shard").agg(F.min("rank").alias("first_rank")))
    return placed.join(firsts, "shard").withColumn("slot", F.col("rank") - F.col("first_rank")).drop("rank", "first_rank")


def shard_documents(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """Placement of every document: doc_id, size, text_crc32, shard and slot (and ``row``, a
    column that numbers the rows, if named)."""
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(content) + 8).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        F.xxhash64(content).alias("key"),
        # Any number that the id decides will do; whole numbers keep their order.
        F.coalesce(F.col(doc_id).cast("string").try_cast("long"), F.xxhash64(doc_id), F.lit(-(2**62))).alias("tie"),
        (F.col(row) if row else F.monotonically_increasing_id()).alias("row"),
    )
    placed = place(cut_lineage(rows), shards)
    return placed.select("doc_id", "size", "text_crc32", "shard", "slot", *(["row"] if row else []))


def write_shards(docs: DataFrame, shards: int, path: str, doc_id: str = "doc_id", text: str = "text", rows_per_file: int = 100_000) -> None:
    """Write all documents whole, one folder a shard, in the order of their slots.

    Rows are numbered in a written copy and placed by these numbers, so that repeated and null
    ids don't matter. All columns are written; folders are named ``shard=...``, or, if the table has
    a column of that name, by the first of ``shard_1``, ``shard_2``, ... that it lacks.
    """
    row, place = free_names(docs, 2)
    taken = {c.lower() for c in docs.columns}
    folder = next(c for c in ("shard", *(f"shard_{i}" for i in range(1, len(taken) + 2))) if c not in taken)
    held = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()))
    placed = shard_documents(held, shards, doc_id, text, row).select(F.col("row").alias(row), F.col("shard").alias(folder), F.col("slot").alias(place))
    rows = held.join(placed, row).drop(row).repartition(folder, F.floor(F.col(place) / rows_per_file))
    rows.sortWithinPartitions(folder, place).drop(place).write.partitionBy(folder).mode("errorifexists").parquet(path)


def op1_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(read_table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
