"""Packing of tokenized rows into blocks, padding, and attention masks."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import IGNORE, PAD_ID, bound
from loomspark.operators.mixing import running_sum

INTS = "array<int>"


def knapsack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of lengths: the largest that fits, again and again; longer ones are left out."""
    rest, bins = sorted(n for n in lengths if n <= capacity), []
    while rest:
        room, held = capacity, []
        while (at := bisect_right(rest, room) - 1) >= 0:
            held.append(rest.pop(at))
            room -= held[-1]
        bins.append(held)
    return bins


def plan_packing(lengths: DataFrame, capacity: int, batch: str, order: str) -> DataFrame:
    """(batch, order) -> block and position; of equal lengths the last row is placed first.

    Only lengths go through Python, and a group is one batch of bounded size.
    """
    kinds = dict(lengths.dtypes)

    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        waiting: dict[int, list] = {}
        for key, n in zip(rows[order], rows["length"]):
            waiting.setdefault(int(n), []).append(key)
        out = [(rows[batch].iloc[0], waiting[n].pop(), b, i) for b, held in enumerate(knapsack(rows["length"].astype(int).tolist(), capacity)) for i, n in enumerate(held)]
        return pd.DataFrame(out, columns=[batch, order, "block", "position"])

    schema = f"`{batch}` {kinds[batch]}, `{order}` {kinds[order]}, block int, position int"
    return lengths.groupBy(batch).applyInPandas(plan, schema)


MEDIA = ("images", "videos", "audios")


def pack_sft(rows: DataFrame, cutoff: int, batch: str, order: str, neat: bool = False, pad_id: int = PAD_ID) -> DataFrame:
    """Blocks of exactly ``cutoff + 1`` ids, labels and mask of several rows, with their media.

    Rows are expected to be cut to the budget before; longer ones are left out (``too_long``
    counts them). With ``neat`` the mask numbers the rows of a block and is 0 in the padding.
    """
    media = [c for c in MEDIA if c in rows.columns]
    plan = plan_packing(rows.select(batch, order, F.size("input_ids").alias("length")), cutoff, batch, order)
    parts = rows.join(plan, [batch, order]).groupBy(batch, "block").agg(F.sort_array(F.collect_list(F.struct("position", order, "input_ids", "labels", *media))).alias("parts"))
    segments = F.flatten(F.transform("parts", lambda p, i: F.array_repeat(i + 1, F.size(p["input_ids"]))))
    each = lambda name: F.transform("parts", lambda p: p[name])
    held = [F.flatten(F.filter(each(c), lambda x: x.isNotNull())).alias(c) for c in media]
    blocks = parts.select(batch, "block", F.size("parts").alias("segments"), each(order).alias("rows"), F.flatten(each("input_ids")).alias("ids"), F.flatten(each("labels")).alias("labels"), segments.alias("mask"), *held)
    pad = F.lit(cutoff + 1) - F.size("ids")
    mask = F.concat("mask", F.array_repeat(F.lit(0), pad)) if neat else F.array_repeat(F.lit(1), cutoff + 1)
    return blocks.select(
        batch,
        "block",
        "segments",
        "rows",
        F.concat("ids", F.array_repeat(F.lit(pad_id), pad)).alias("input_ids"),
        mask.alias("attention_mask"),
        F.concat("labels", F.array_repeat(F.lit(IGNORE), pad)).alias("labels"),
        *(F.when(F.size(c) > 0, F.col(c)).alias(c) for c in media),
    )


def too_long(rows: DataFrame, cutoff: int, batch: str) -> DataFrame:
    """Rows of each batch that no block can hold, and their longest."""
    n = F.size("input_ids")
    return rows.groupBy(batch).agg(F.count_if(n > cutoff).alias("dropped"), F.max(F.when(n > cutoff, n)).alias("longest"))


def segment_lengths(mask: Column) -> Column:
    """Lengths of the numbered segments of one mask, zeros left out.

    Segments that stand in order, as packing numbers them, are read off their borders; others
    are counted number by number.
    """
    held = lambda places: F.filter(places, lambda i: i.isNotNull())

    def lengths(m: Column) -> Column:
        first = held(F.transform(m, lambda x, i: F.when((x != 0) & ((i == 0) | (F.get(m, i - 1) != x)), i)))
        behind = held(F.transform(m, lambda x, i: F.when((x != 0) & ((i == F.size(m) - 1) | (F.get(m, i + 1) != x)), i + 1)))
        numbers = F.transform(first, lambda i: F.get(m, i))
        last = F.coalesce(F.array_max(m), F.lit(0))
        counts = F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda s: F.size(F.filter(m, lambda x: x == s))))
        counted = F.filter(F.coalesce(counts, F.array().cast(INTS)), lambda n: n > 0)
        ordered = bound(numbers, lambda n: n == F.array_sort(F.array_distinct(n)))
        return F.when(ordered, F.zip_with(first, behind, lambda a, b: b - a)).otherwise(counted)

    return bound(mask, lengths)


def unpadded(rows: DataFrame, order: str, mask: str = "attention_mask") -> DataFrame:
    """Flat places of the non-zero mask values over all rows, with their segment's running start.

    One row a segment: its row, number, length and cumulative length before it.
    """
    lengths = rows.select(order, F.posexplode(segment_lengths(F.col(mask))).alias("segment", "length"))
    totals = lengths.groupBy(order).agg(F.sum("length").alias("__total"))
    before = running_sum(totals, [F.col(order)], "__total", "__upto").select(order, (F.col("__upto") - F.col("__total")).alias("__before"))
    inside = F.sum("length").over(Window.partitionBy(order).orderBy("segment"))
    return lengths.join(before, order).select(order, "segment", "length", (F.col("__before") + inside - F.col("length")).alias("cu_start"), (F.col("__before") + inside).alias("cu_end"))


def flat_indices(mask: Column) -> Column:
    """Places of the non-zero values of a mask."""
    return F.filter(F.transform(mask, lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull())


def pad_batches(rows: DataFrame, batch: str, multiple: int = 8, pad_id: int = PAD_ID, label_pad: int = IGNORE, left: bool = False, ids: str = "input_ids", mask: str = "attention_mask", labels: str = "labels") -> DataFrame:
    """Pad every batch to its longest row, rounded up to a multiple."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    rows = rows.withColumn("padded_length", (F.ceil(longest / multiple) * multiple).cast("int"))

    def padded(column: str, value: int) -> Column:
        fill = F.array_repeat(F.lit(value), F.greatest(F.col("padded_length") - F.size(column), F.lit(0)))
        return F.concat(fill, column) if left else F.concat(column, fill)

    made = {c: padded(c, v) for c, v in ((ids, pad_id), (mask, 0), (labels, label_pad)) if c in rows.columns}
    return rows.withColumns(made)


def attended(mask: Column) -> Column:
    """How many places each place may look at: those before it in its own segment."""
    return F.transform(mask, lambda s, i: F.when(s != 0, F.size(F.filter(F.slice(mask, F.lit(1), i + 1), lambda x: x == s))).otherwise(0))


def mask_pairs(rows: DataFrame, order: str, mask: str = "attention_mask") -> DataFrame:
    """The block-diagonal causal mask in long form: (order, i, j) that are visible."""
    places = rows.select(order, mask, F.posexplode(mask).alias("i", "segment")).where("segment <> 0")
    seen = F.filter(F.transform(F.slice(F.col(mask), F.lit(1), F.col("i") + 1), lambda x, j: F.when(x == F.col("segment"), j)), lambda j: j.isNotNull())
    return places.select(order, "i", F.explode(seen).alias("j"))


def dense_mask(mask: Column, low: float = float("-inf")) -> Column:
    """A row's mask as a matrix of 0 (visible) and ``low``; for short rows only."""
    return F.transform(mask, lambda s, i: F.transform(mask, lambda t, j: F.when((s == t) & (s != 0) & (j <= i), F.lit(0.0)).otherwise(F.lit(low))))


def attention_mask(mask: Column, block_diagonal: bool, attention: str = "sdpa") -> Column:
    """The mask a model is given: a matrix (``dense_mask``) where rows of a block have to be kept
    apart and its attention takes one, else the mask as it is, as doubles."""
    if block_diagonal and attention != "flash_attention_2":
        return dense_mask(mask)
    return F.transform(mask, lambda x: x.cast("double"))


def pair_batch(rows: DataFrame, order: str) -> DataFrame:
    """Two rows of each pair: all chosen, then all rejected."""
    sides = []
    for i, side in enumerate(("chosen", "rejected")):
        sides.append(rows.select(order, F.lit(i).alias("side"), *(F.col(f"{side}_{c}").alias(c) for c in ("input_ids", "attention_mask", "labels"))))
    return sides[0].unionByName(sides[1])


def kto_batch(rows: DataFrame, batch: str, order: str, multiple: int = 8) -> DataFrame:
    """Target and mismatched sequences, each padded within its batch."""
    main = pad_batches(rows, batch, multiple).withColumnRenamed("padded_length", "target_length")
    kl = pad_batches(main, batch, multiple, ids="kl_input_ids", mask="kl_attention_mask", labels="kl_labels")
    return kl.withColumnRenamed("padded_length", "kl_length")


def chosen_only(rows: DataFrame, train_on_prompt: bool) -> DataFrame:
    """The chosen side alone, for perplexities; labels are all ids if the prompt counts."""
    labels = F.col("chosen_input_ids") if train_on_prompt else F.col("chosen_labels")
    return rows.select(*(c for c in rows.columns if not c.startswith(("chosen_", "rejected_"))), F.col("chosen_input_ids").alias("input_ids"), F.col("chosen_attention_mask").alias("attention_mask"), labels.alias("labels"))
