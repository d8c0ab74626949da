"""Finding the row of a given rank without sorting, and numbering rows where they stand.

Selection goes digit by digit: rows are counted by the next digits of their keys, which leaves
one small table of counts (its size is a parameter), the digits that hold the rank are fixed,
and only rows with them are counted in the next round. A sample or a split is then a filter
by the key found. Nothing is ranked, moved or gathered but the last few candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import hash_order

#: Hex digits that a round looks at (a table of 16^n counts), and candidates that may be gathered.
DIGITS, GATHERED = 3, 4096


def hex_of(value: Column, kind: str) -> Column | None:
    """A fixed-length text of hex digits in the order of whole numbers, dates or times; null for
    other kinds of values."""
    if kind in ("date",):
        value, kind = F.datediff(value, F.lit("1970-01-01").cast("date")), "int"
    if kind == "timestamp":
        value, kind = F.unix_micros(value), "bigint"
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        return None
    # The sign bit is flipped, so that negative numbers come first.
    return F.lpad(F.hex(value.cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")


def key_at(df: DataFrame, key: Column, rank: int, width: int) -> tuple[str, int] | None:
    """The key (hex digits, ``width`` of them) of the row of a rank from 0, in the order of keys,
    and how many rows have smaller keys; None beyond the last row."""
    rows = df.select(key.alias("k"))
    known, before = "", 0
    while True:
        digits = min(DIGITS, width - len(known))
        part = F.substring("k", len(known) + 1, digits)
        counts = sorted((r["d"], r["n"]) for r in rows.groupBy(part.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect() if r["d"] is not None)
        for found, n in counts:
            if rank < before + n:
                break
            before += n
        else:
            return None
        known += found
        if len(known) == width:
            return known, before
        rows = rows.where(F.col("k").startswith(known))
        if n <= GATHERED:
            keys = sorted(r["k"] for r in rows.collect())
            wanted = keys[rank - before]
            return wanted, before + keys.index(wanted)


def first_of(df: DataFrame, key: Column, n: int, width: int, tie: str | None = None) -> DataFrame:
    """Exactly the first ``n`` rows in the order of a key of hex digits, without a sort.

    Among rows of the very last key, if not all fit, those of the smaller ``tie`` count (any, if
    it is equal too).
    """
    if n <= 0:
        return df.limit(0)
    found = key_at(df, key, n - 1, width)
    if found is None:
        return df
    last, before = found
    same = df.where(key == last)
    left = n - before
    if same.count() == left:
        return df.where(key <= last)
    order = [F.col(tie)] if tie else []
    return df.where(key < last).unionByName(same.orderBy(*order).limit(left) if order else same.limit(left))


def first_in_hash_order(df: DataFrame, n: int, key: str, seed: int | str) -> DataFrame:
    """The first ``n`` rows in the hash order of a key."""
    return first_of(df, hash_order(seed, F.col(key)), n, 32, key)


def hash_threshold(df: DataFrame, n: int, key: str, seed: int | str) -> tuple[str, object] | None:
    """(hash, key) of the n-th row in hash order, from 1; None if there are fewer."""
    order = hash_order(seed, F.col(key))
    found = key_at(df, order, n - 1, 32)
    if found is None:
        return None
    last, before = found
    # Different keys of one hash are as good as none; equal keys are one candidate.
    keys = df.where(order == last).groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(key).limit(GATHERED).collect()
    for r in keys:
        before += r["n"]
        if before >= n:
            return last, r[key]
    return last, keys[-1][key]


def number_in_place(df: DataFrame, name: str = "rid", touched: list[str] | None = None) -> DataFrame:
    """Consecutive numbers from 0 in the order in which rows stand in their partitions.

    For plans that give the same partitions whenever they run, as scans of files do: rows are
    counted by partition (one row each), and a row's number is its place behind those of
    the partitions in front. Nothing is moved. ``touched`` names columns that have to be read for
    the count, where a reader may otherwise leave out broken rows.
    """
    placed = df.withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33)
    read = [F.max(F.xxhash64(*(F.col(f"`{c}`") for c in touched))).alias("__read")] if touched else []
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"), *read)
    starts = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__start"))
    numbered = placed.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return numbered.withColumn(name, F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__part", "__start", "__at")
