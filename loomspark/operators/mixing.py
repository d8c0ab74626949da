"""Sampling, limits, order, mixing of datasets and splits.

Row order is an explicit ordinal, and every shuffle is an order by a hash of seed and key, so
results don't depend on partitions and SQL engines can repeat them. Counts are one-row
aggregates; positions inside a dataset come from ranges of the ordinal (``number_rows``),
never from a window over all rows in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.functions.lineage import cut_lineage
from loomspark.functions.text import hash_order
from loomspark.operators.selection import first_in_hash_order, first_of, hash_threshold, hex_of, key_at


def in_order(df: DataFrame, order: list[Column], parts: int | None) -> DataFrame:
    """Rows range-partitioned and sorted, with ``__part`` and ``__place`` in it.

    Ranges come from a sample, so they are written down before anything counts them.
    """
    ranged = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    placed = cut_lineage(ranged.sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    return placed.withColumns({"__part": F.shiftright("__at", 33), "__place": F.col("__at").bitwiseAND((1 << 33) - 1)}).drop("__at")


def number_rows(df: DataFrame, order: list[Column], name: str = "rid", parts: int | None = None) -> DataFrame:
    """Consecutive numbers from 0 in the given order, without a single-task window.

    The sizes of the ranges (one row each) give each range its first number. Equal rows get
    different numbers.
    """
    placed = in_order(df, order, parts)
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__start"))
    numbered = placed.join(F.broadcast(starts), "__part")
    return numbered.withColumn(name, F.col("__start") + F.col("__place")).drop("__part", "__start", "__place")


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], by: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Sums over all rows up to each row, of all rows or of those of a group.

    The sums of each range of rows (one row a range and group) give what came before; a group
    of any size is spread over as many ranges as it needs, so no task holds one.
    """
    by = by or []
    given = df.withColumns({f"__{n}": c for n, c in sums.items()})
    placed = in_order(given, [*(F.col(c) for c in by), *order], parts)
    totals = placed.groupBy("__part", *by).agg(*(F.sum(f"__{n}").alias(f"__t{n}") for n in sums))
    earlier = Window.partitionBy(*by).orderBy("__part")
    starts = totals.select("__part", *by, *((F.sum(f"__t{n}").over(earlier) - F.col(f"__t{n}")).alias(f"__s{n}") for n in sums))
    inside = Window.partitionBy("__part", *by).orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.withColumns({f"__i{n}": F.sum(f"__{n}").over(inside) for n in sums})
    match = F.col("l.__part") == F.col("r.__part")
    for c in by:
        match = match & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    joined = rows.alias("l").join(starts.alias("r"), match)
    kept = [F.col(f"l.{c}") for c in df.columns]
    return joined.select(*kept, *((F.col(f"r.__s{n}") + F.col(f"l.__i{n}")).alias(n) for n in sums))


def linear_scan(df: DataFrame, order: list[Column], factor: Column, addend: Column, name: str, by: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """``s = factor * s_before + addend`` along all rows, or along those of each group, from s = 0.

    Such steps are associative (a step is a pair of numbers, and two in a row are one of
    ``a1 * a2, a2 * b1 + b2``), so each range of rows is gone through by itself, what a range does
    to a group's value is one pair, and the pairs of earlier ranges give what comes in. A group
    of any size is spread over as many ranges as it needs; a null factor or addend counts as 1 or 0.
    """
    by = by or []
    given = df.withColumns({"__a": F.coalesce(factor.cast("double"), F.lit(1.0)), "__b": F.coalesce(addend.cast("double"), F.lit(0.0))})
    placed = in_order(given, [*(F.col(c) for c in by), *order], parts)
    group = F.struct(F.col("__part").alias("__part"), *(F.col(c) for c in by)).alias("__group")
    # One number for each run of equal groups: rows are in order, so a group is one run a range.
    keyed = placed.withColumn("__run", F.xxhash64(group))
    schema = T.StructType([*keyed.schema.fields, T.StructField("__inner", T.DoubleType()), T.StructField("__decay", T.DoubleType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, value, decay = None, 0.0, 1.0
        for batch in batches:
            inner, decays = [], []
            for key, a, b in zip(*(batch.column(c).to_pylist() for c in ("__run", "__a", "__b"))):
                if key != run:
                    run, value, decay = key, 0.0, 1.0
                value, decay = a * value + b, a * decay
                inner.append(value)
                decays.append(decay)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(inner, pa.float64()), pa.array(decays, pa.float64())], schema.names)

    walked = cut_lineage(keyed.mapInArrow(walk, schema))
    ends = walked.groupBy("__part", *by).agg(F.max_by(F.struct("__decay", "__inner"), "__place").alias("__end"))
    # One pair a range that holds rows of the group.
    pairs = F.array_sort(F.collect_list(F.struct("__part", "__end.__decay", "__end.__inner")))
    before = F.transform("p", lambda x: F.struct(x["__part"].alias("__part"), F.aggregate(F.filter("p", lambda y: y["__part"] < x["__part"]), F.lit(0.0), lambda s, y: y["__decay"] * s + y["__inner"]).alias("__in")))
    starts = ends.groupBy(*by).agg(pairs.alias("p")).select(*by, F.inline(before))
    match = F.col("l.__part") == F.col("r.__part")
    for c in by:
        match = match & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    joined = walked.alias("l").join(starts.alias("r"), match)
    return joined.select(*(F.col(f"l.{c}") for c in df.columns), (F.col("l.__decay") * F.col("r.__in") + F.col("l.__inner")).alias(name))


def running_sum(df: DataFrame, order: list[Column], value: str, name: str, parts: int | None = None) -> DataFrame:
    """Sum of a column over all rows up to each row, without a single-task window."""
    return running_sums(df, order, {name: F.col(value)}, parts=parts)


def first_rows(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first ``n`` rows in the order of a column: by selection for numbers, dates and times, by
    a sort of the column's ranges for other kinds."""
    key = hex_of(F.col(order), dict(df.dtypes)[order])
    if key is not None:
        missing = df.where(F.col(order).isNull())
        nulls = missing.count()
        if nulls >= n:
            return missing.limit(n)
        rest = first_of(df.where(F.col(order).isNotNull()), key, n - nulls, 16)
        return missing.unionByName(rest) if nulls else rest
    return number_rows(df, [F.col(order)], "__rank").where(F.col("__rank") < n).drop("__rank")


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows with their ``draw``: a hash-ordered prefix; beyond the number of
    rows, all rows and then draws with repetition."""
    total = df.count()
    if n <= total:
        return first_in_hash_order(df, n, key, seed).withColumn("draw", F.lit(0))
    if not total:
        return df.withColumn("draw", F.lit(0)).limit(0)
    spark = df.sparkSession
    drawn = spark.range(1, n - total + 1).select(F.col("id").cast("int").alias("draw"))
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("again"), F.col("draw").cast("string"))), 1, 8), 16, 10).cast("long")
    drawn = drawn.withColumn("rid", F.pmod(number, F.lit(total)))
    numbered = number_rows(df, [F.col(key)], "__rid")
    again = drawn.withColumnRenamed("rid", "__rid").join(numbered, "__rid").drop("__rid")
    return df.withColumn("draw", F.lit(0)).unionByName(again)


def page(df: DataFrame, index: int, order: str, size: int = 2) -> DataFrame:
    """One page of rows: what is in front of it is found by selection, so only a page is sorted."""
    key = hex_of(F.col(order), dict(df.dtypes)[order])
    if not index or key is None or not df.where(F.col(order).isNull()).isEmpty():
        return df.orderBy(order).offset(index * size).limit(size)
    found = key_at(df, key, index * size, 16)
    if found is None:
        return df.limit(0)
    first, before = found
    return df.where(key >= first).orderBy(order).offset(index * size - before).limit(size)


def training_order(df: DataFrame, key: str, seed: int, epoch: int = 0, shuffle: bool = True) -> DataFrame:
    """Rows with a ``rank`` to read them by: shuffled anew each epoch, or as they stand."""
    order = [hash_order(f"{seed}:{epoch}", F.col(key)), F.col(key)] if shuffle else [F.col(key)]
    return number_rows(df, order, "rank")


def check_mix(strategy: str, datasets: int, probabilities: list[float] | None) -> None:
    if strategy not in ("concat", "interleave_under", "interleave_over"):
        raise ValueError(f"Unknown mixing strategy: {strategy}.")
    if probabilities and strategy == "concat":
        raise ValueError("Probabilities are only for interleaving.")
    if probabilities and len(probabilities) != datasets:
        raise ValueError("The number of probabilities is not the number of datasets.")


def mix(datasets: list[DataFrame], strategy: str = "concat", probabilities: list[float] | None = None, seed: int = 42, rid: str = "rid") -> DataFrame:
    """One dataset of several, each with consecutive ``rid`` from 0; adds ds_idx and mix_pos.

    A single dataset is returned as it is, whatever the strategy. ``interleave_under`` stops
    when the first dataset is exhausted, ``interleave_over`` when all are, shorter ones
    starting over.
    """
    if len(datasets) == 1:
        return datasets[0].withColumn("ds_idx", F.lit(0)).withColumn("mix_pos", F.col(rid))
    check_mix(strategy, len(datasets), probabilities)
    tagged = reduce(DataFrame.unionByName, [d.withColumn("ds_idx", F.lit(i)) for i, d in enumerate(datasets)])
    counts = {r["ds_idx"]: r["n"] for r in tagged.groupBy("ds_idx").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = [counts.get(i, 0) for i in range(len(datasets))]
    k = len(datasets)
    if strategy == "concat":
        starts = F.element_at(F.array(*(F.lit(sum(sizes[:i])) for i in range(k))), F.col("ds_idx") + 1)
        return tagged.withColumn("mix_pos", (starts + F.col(rid)).cast("long"))
    if probabilities:
        return interleave_by_chance(tagged, sizes, probabilities, strategy, seed, rid)
    if strategy == "interleave_under":
        rounds = min(sizes)
        return tagged.where(F.col(rid) < rounds).withColumn("mix_pos", F.col(rid) * k + F.col("ds_idx"))
    rounds = max(sizes)
    # A row of a shorter dataset comes again every size-th round: each round asks for its row.
    steps = tagged.sparkSession.range(rounds * k).select(F.col("id").alias("mix_pos"), (F.col("id") % k).cast("int").alias("ds_idx"), F.floor(F.col("id") / k).alias("__round"))
    size = F.element_at(F.array(*(F.lit(max(1, s)) for s in sizes)), F.col("ds_idx") + 1)
    wanted = steps.select("mix_pos", "ds_idx", (F.col("__round") % size).cast("long").alias(rid))
    return wanted.join(tagged, ["ds_idx", rid])


def chosen(step: Column, shares: list[float], seed: int) -> Column:
    """The dataset of a step: a hashed number picks it by the shares."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("mix"), step.cast("string"))), 1, 8), 16, 10).cast("double") / float(2**32)
    choice = F.lit(len(shares) - 1)
    for i in range(len(shares) - 2, -1, -1):
        choice = F.when(u < sum(shares[: i + 1]), F.lit(i)).otherwise(choice)
    return choice


def interleave_by_chance(tagged: DataFrame, sizes: list[int], probabilities: list[float], strategy: str, seed: int, rid: str) -> DataFrame:
    """A hashed number picks each step's dataset; picks are numbered per dataset."""
    spark = tagged.sparkSession
    total = sum(probabilities)
    shares = [p / total for p in probabilities]
    want = [s / p for s, p in zip(sizes, shares) if p > 0]
    length = int((min(want) if strategy == "interleave_under" else max(want)) * 1.5) + 64 * len(sizes)
    while True:
        steps = number_picks(spark.range(length).select(F.col("id").alias("mix_pos"), chosen(F.col("id"), shares, seed).alias("ds_idx")), len(sizes))
        ends = {r["ds_idx"]: r["last"] for r in steps.where(F.element_at(F.array(*(F.lit(s) for s in sizes)), F.col("ds_idx") + 1) == F.col("pick") + 1).groupBy("ds_idx").agg(F.min("mix_pos").alias("last")).collect()}
        needed = [i for i, p in enumerate(shares) if p > 0]
        done = ends if strategy == "interleave_under" else (ends if all(i in ends for i in needed) else {})
        if done:
            stop = min(done.values()) if strategy == "interleave_under" else max(done.values())
            break
        length *= 2
    size = F.element_at(F.array(*(F.lit(max(1, s)) for s in sizes)), F.col("ds_idx") + 1)
    steps = steps.where(F.col("mix_pos") <= stop).select("mix_pos", "ds_idx", (F.col("pick") % size).cast("long").alias(rid))
    return steps.join(tagged, ["ds_idx", rid])


def number_picks(steps: DataFrame, datasets: int, chunk: int = 100_000) -> DataFrame:
    """``pick``: how often a step's dataset was chosen before, chunk by chunk."""
    steps = steps.withColumn("__chunk", F.floor(F.col("mix_pos") / chunk))
    counts = steps.groupBy("ds_idx", "__chunk").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("ds_idx", "__chunk", (F.sum("__n").over(Window.partitionBy("ds_idx").orderBy("__chunk")) - F.col("__n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("ds_idx", "__chunk").orderBy("mix_pos")) - 1
    return steps.join(before, ["ds_idx", "__chunk"]).withColumn("pick", F.col("__before") + place).drop("__chunk", "__before")


def validation_size(val_size: float, n: int) -> int:
    """Rows of the validation set: a share (rounded up) up to 1, a number of rows beyond."""
    if val_size <= 1e-6:
        return 0
    return int(val_size) if val_size > 1 else -int(-val_size * n // 1)


def split(df: DataFrame, val_size: float, key: str, seed: int = 42) -> dict[str, DataFrame]:
    """Disjoint train and validation sets of exact sizes, by the hash order of a unique key."""
    if val_size <= 1e-6:
        return {"train": df}
    n = validation_size(val_size, df.count())
    last = hash_threshold(df, n, key, seed)
    if last is None:
        return {"train": df.limit(0), "validation": df}
    place = F.struct(hash_order(seed, F.col(key)).alias("h"), F.col(key).alias("k"))
    inside = place <= F.struct(F.lit(last[0]).alias("h"), F.lit(last[1]).cast(dict(df.dtypes)[key]).alias("k"))
    return {"train": df.where(~inside), "validation": df.where(inside)}


def few_shot(targets: DataFrame, supports: DataFrame, group: str, item: str, support: str, shots: int, seed: int = 42) -> DataFrame:
    """For each target its ``shots`` supports of the same group, in hash order, with shot_rank.

    To avoid pairing a group with itself, supports are put on a ring in hash order and each
    target takes the ones behind its own place, so a group of any size costs its targets
    times the shots.
    """
    numbered = number_rows(supports.select(group, support), [F.col(group), hash_order(seed, F.col(support)), F.col(support)], "__number")
    sizes = numbered.groupBy(group).agg(F.count(F.lit(1)).alias("__n"), F.min("__number").alias("__first"))
    placed = numbered.join(sizes.select(group, "__first"), group).select(group, support, (F.col("__number") - F.col("__first")).cast("int").alias("__at"))
    sizes = sizes.drop("__first")
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("shot"), F.col(item).cast("string"))), 1, 8), 16, 10).cast("long")
    wanted = targets.select(group, item).join(sizes, group).withColumn("__k", F.explode(F.sequence(F.lit(0), F.least(F.lit(shots), F.col("__n").cast("int")) - 1)))
    wanted = wanted.withColumn("__at", F.pmod(number + F.col("__k"), F.col("__n")).cast("int"))
    return wanted.join(placed, [group, "__at"]).select(group, item, support, (F.col("__k") + 1).alias("shot_rank"))
