"""Statistics of token rows and of training and evaluation output."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from loomspark.functions.text import IGNORE
from loomspark.operators.mixing import linear_scan, running_sums


def length_histogram(rows: DataFrame, length: Column, interval: int = 1000) -> DataFrame:
    """Rows by length bucket, with the running count and percentage.

    There is one row a bucket before the window, so its single partition stays small.
    """
    buckets = rows.groupBy((F.floor(length / interval) * interval).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(Window.partitionBy())
    return buckets.select("bucket", "n", F.sum("n").over(order).alias("running"), (100.0 * F.sum("n").over(order) / total).alias("percent"))


def valid_ratio(rows: DataFrame, batch: str, labels: str = "labels") -> DataFrame:
    """Share of labels that count among all places of padded batches."""
    counted = rows.select(batch, F.size(labels).alias("n"), F.size(F.filter(labels, lambda x: x != IGNORE)).alias("valid"))
    batches = counted.groupBy(batch).agg(F.sum("valid").alias("valid"), (F.max("n") * F.count(F.lit(1))).alias("places"))
    return batches.agg(F.sum("valid").alias("valid_tokens"), F.sum("places").alias("total_tokens"), (F.sum("valid") / F.sum("places")).alias("valid_ratio"))


def learning_rate(cutoff: Column, batch_size: Column, ratio: Column, halved_family: Column) -> Column:
    """A rule-of-thumb rate that grows with the square root of the valid tokens of a batch."""
    base = 3e-4 * F.sqrt(cutoff * batch_size * ratio / 4e6)
    return F.when(halved_family, base / 6.0).otherwise(base)


def tokens_per_second(rows: DataFrame, lengths: list[Column], epochs: float, runtime: float, world_size: int = 1) -> DataFrame:
    total = F.sum(sum(lengths[1:], lengths[0]))
    return rows.agg(total.cast("long").alias("tokens"), (total * epochs / runtime / world_size).alias("tokens_per_second"))


def token_accuracy(predictions: Column, labels: Column) -> Column:
    """Share of the counting labels that the prediction one place earlier meets; NaN if none."""
    n = F.size(labels)
    pairs = F.zip_with(F.slice(predictions, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(labels, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda p, t: F.when(t != IGNORE, (p == t).cast("int")))
    used = F.filter(pairs, lambda x: x.isNotNull())
    hits = F.aggregate(used, F.lit(0), lambda a, x: a + x)
    return F.when(F.size(used) > 0, hits / F.size(used)).otherwise(F.lit(float("nan")))


def mean_scores(rows: DataFrame, columns: list[str], skip_nan: bool = False) -> DataFrame:
    """Means of score columns; a NaN spoils its mean unless skipped."""
    pick = lambda c: F.when(~F.isnan(c), F.col(c)) if skip_nan else F.col(c)
    return rows.agg(*(F.avg(pick(c)).alias(c) for c in columns))


def argmax(values: Column) -> Column:
    """The first place (from 0) of the largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def choice_letter(logits: Column) -> Column:
    return F.element_at(F.array(*(F.lit(c) for c in "ABCD")), argmax(logits) + 1)


def at_last_token(values: Column, mask: Column) -> Column:
    """The value at the last real token of a row."""
    return F.try_element_at(values, F.aggregate(mask, F.lit(0), lambda a, x: a + x))


def sequence_perplexity(nll: Column, labels: Column) -> Column:
    """exp of the mean loss of the shifted labels that count."""
    pairs = F.zip_with(nll, F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0))), lambda x, t: F.when(t != IGNORE, x))
    used = F.filter(pairs, lambda x: x.isNotNull())
    return F.exp(F.aggregate(used, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(used), F.lit(0)))


#: The categories in the order of reports.
CATEGORIES = ("Average", "STEM", "Social Sciences", "Humanities", "Other")


def category_accuracy(rows: DataFrame, category: str, correct: Column) -> DataFrame:
    """Accuracy in percent of each category and over all rows, as category "Average"."""
    scored = rows.select(F.col(category).alias("category"), correct.cast("double").alias("c"))
    out = scored.rollup("category").agg((100.0 * F.avg("c")).alias("accuracy"), F.count(F.lit(1)).alias("n"), F.grouping("category").alias("g"))
    return out.where("g = 1 or category is not null").select(F.when(F.col("g") == 1, "Average").otherwise(F.col("category")).alias("category"), "accuracy", "n")


def loss_perplexity(loss: Column) -> Column:
    """exp of a mean loss; beyond the range of doubles it is infinite."""
    return F.exp(loss)


def step_counts(batch: int, accumulation: int, buffer: int, world: int, epochs: float, rows: int) -> dict[str, int]:
    """Examples and steps of a run that collects ``buffer`` batches before each update."""
    backward = batch * accumulation * buffer * world
    total_batch = backward
    per_epoch = max(1, -(-rows // total_batch))
    return {"backward_batch": batch * accumulation, "total_batch": total_batch, "steps_per_epoch": per_epoch, "total_steps": math.ceil(epochs * per_epoch)}


def preference_log(rows: DataFrame, group: str, liked: str, values: list[str]) -> DataFrame:
    """Means of value columns over chosen and rejected rows, and their difference."""
    parts = []
    for v in values:
        good, bad = F.avg(F.when(F.col(liked), F.col(v))), F.avg(F.when(~F.col(liked), F.col(v)))
        parts += [good.alias(f"{v}_chosen"), bad.alias(f"{v}_rejected"), (good - bad).alias(f"{v}_margin")]
    return rows.groupBy(group).agg(*parts)


def mean_of_batches(rows: DataFrame, batch: str, values: list[str]) -> DataFrame:
    """The mean over batches of each batch's mean."""
    return rows.groupBy(batch).agg(*(F.avg(v).alias(v) for v in values)).agg(*(F.avg(v).alias(v) for v in values))


def running_average(rows: DataFrame, value: str, weight: str, group: str, order: str) -> DataFrame:
    """Weighted mean of everything up to each row of a group, however large the group."""
    sums = {"__weighted": F.col(value) * F.col(weight), "__weights": F.col(weight)}
    made = running_sums(rows, [F.col(order)], sums, [group])
    return made.withColumn("average", F.col("__weighted") / F.col("__weights")).drop("__weighted", "__weights")


def throughput(log: DataFrame, tokens: str = "total_tokens", elapsed: str = "elapsed_seconds") -> DataFrame:
    """Tokens seen so far by the time they took, to two places; null before any time passed."""
    return log.withColumn("throughput", F.when(F.col(elapsed) > 0, F.bround(F.col(tokens) / F.col(elapsed), 2)))


def smoothing_weight(n: Column) -> Column:
    return 1.8 * (1 / (1 + F.exp(-0.05 * n)) - 0.5)


def smoothed(series: Column) -> Column:
    """Exponential moving average of an array, whose weight grows with its length.

    s[i] = w s[i-1] + (1 - w) x[i], from s = x[0].
    """
    w = smoothing_weight(F.size(series).cast("double"))

    def step(state: Column, x: Column) -> Column:
        value = state["last"] * w + (1 - w) * x
        return F.struct(value.alias("last"), F.concat(state["all"], F.array(value)).alias("all"))

    start = F.struct(F.coalesce(F.try_element_at(series, F.lit(1)), F.lit(0.0)).alias("last"), F.array().cast("array<double>").alias("all"))
    return F.aggregate(series, start, step, lambda s: s["all"])


def smoothed_rows(rows: DataFrame, value: str, order: list[str], group: str | None = None, name: str = "smoothed") -> DataFrame:
    """The moving average of ``smoothed`` along rows, for groups of any size.

    The weight follows the number of values in the group; the first value is where it starts.
    """
    by = [group or "__all"]
    rows = rows if group else rows.withColumn("__all", F.lit(0))
    # One row a group, with its first row's place.
    counts = rows.groupBy(*by).agg(F.count(value).alias("__n"), F.min_by(F.struct(*order), F.struct(*order)).alias("__first"))
    held = rows.join(counts, by)
    w = smoothing_weight(F.col("__n").cast("double"))
    first = F.struct(*order) == F.col("__first")
    made = linear_scan(held, [F.col(c) for c in order], F.when(first, 0.0).otherwise(w), F.when(first, F.col(value)).otherwise((1 - w) * F.col(value)), name, by)
    return made.drop("__n", "__first", "__all")


def clock(seconds: Column) -> Column:
    """Seconds as ``[D day[s], ]H:MM:SS``."""
    s = seconds.cast("long")
    days = F.floor(s / 86400)
    time = F.format_string("%d:%02d:%02d", F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60), s % 60)
    return F.when(days == 0, time).otherwise(F.concat(days.cast("string"), F.when(days == 1, " day, ").otherwise(" days, "), time))


def progress(current: Column, total: Column, elapsed: Column) -> dict[str, Column]:
    """Percentage, elapsed and remaining time of a run."""
    each = F.when(current > 0, elapsed / current).otherwise(F.lit(0.0))
    return {
        "percentage": F.when(total > 0, F.bround(current / total * 100, 2)).otherwise(F.lit(100.0)),
        "elapsed_time": clock(elapsed),
        "remaining_time": clock((total - current) * each),
    }


def model_flops(c: dict[str, Column], backward: bool = True, recompute: bool = False, flash: bool = False) -> Column:
    """Operations of a step in closed form, from columns hidden, vocab, intermediate, heads,
    kv_heads, layers, tied, batch and seq. A multiply-add counts two."""
    tokens = c["batch"] * c["seq"]
    mlp = 6 * c["hidden"] * c["intermediate"] * tokens * c["layers"]
    kv = F.floor(2 * c["hidden"] * c["hidden"] * c["kv_heads"] / c["heads"])
    projections = (4 * c["hidden"] * c["hidden"] + 2 * kv) * tokens * c["layers"]
    attention = 4 * c["hidden"] * c["seq"] * c["seq"] * c["batch"] * c["layers"]
    embedding = c["hidden"] * c["vocab"] * tokens * F.when(c["tied"], 1).otherwise(2)
    passes = 1 + 2 * int(backward)
    return (mlp + projections + attention) * (passes + int(recompute)) + embedding * passes + (attention if flash else F.lit(0))


#: Peak operations a second by device family.
DEVICE_FLOPS = {"H100": 989e12, "H800": 989e12, "A100": 312e12, "A800": 312e12, "V100": 125e12, "4090": 98e12}


def utilisation(steps_per_second: Column, flops: Column, device: str, world_size: int) -> Column:
    known = next((v for k, v in DEVICE_FLOPS.items() if k in device), None)
    if known is None:
        raise ValueError(f"The peak of {device} is not known.")
    return steps_per_second * flops / (known * world_size)


def ngrams(words: list[str], n: int) -> Counter:
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def overlap_f(hits: int, said: int, wanted: int) -> float:
    p, r = hits / said if said else 0.0, hits / wanted if wanted else 0.0
    return 2 * p * r / (p + r) if p + r else 0.0


def rouge_n(said: list[str], wanted: list[str], n: int) -> float:
    """F score of distinct n-grams."""
    a, b = (set(zip(*(words[i:] for i in range(n)))) for words in (said, wanted))
    return overlap_f(len(a & b), len(a), len(b))


def rouge_l(said: list[str], wanted: list[str]) -> float:
    """F score of the longest common subsequence.

    A column of the table is the set of places where its value grows, kept as the bits of one
    number, so a word costs a few operations on whole numbers of ``len(wanted)`` bits.
    """
    places: dict[str, int] = {}
    for j, y in enumerate(wanted):
        places[y] = places.get(y, 0) | 1 << j
    full = (1 << len(wanted)) - 1
    same = full
    for x in said:
        met = same & places.get(x, 0)
        same = ((same + met) | (same - met)) & full
    return overlap_f(len(wanted) - same.bit_count(), len(said), len(wanted))


def bleu4(said: str, wanted: str) -> float:
    """Sentence BLEU-4 over characters; a missing order counts half as much as the one before
    (smoothing by geometric decay)."""
    if not said:
        return 0.0
    total, decay = 0.0, 1
    for n in range(1, 5):
        a, b = ngrams(list(said), n), ngrams(list(wanted), n)
        hits, size = sum((a & b).values()), max(1, sum(a.values()))
        if n == 1 and not hits:
            return 0.0
        if hits:
            total += math.log(hits / size) / 4
        else:
            decay *= 2
            total += math.log(1 / (decay * size)) / 4
    brevity = 1.0 if len(said) > len(wanted) else math.exp(1 - len(wanted) / len(said))
    return brevity * math.exp(total)


def similarity_scores(predicted: Column, label: Column, segment=str.split, bleu: bool = True) -> Column:
    """ROUGE-1, -2, -L (F, of segmented words) and BLEU-4, in percent to four places.

    ``segment`` splits a text into words; an empty side scores 0. Without ``bleu`` only the ROUGE
    scores are computed and returned.
    """
    names = ["rouge_1", "rouge_2", "rouge_l"] + ["bleu_4"] * bleu

    @pandas_udf(f"struct<{','.join(f'{n}:double' for n in names)}>")
    def score(said: pd.Series, wanted: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(said.fillna(""), wanted.fillna("")):
            x, y = list(segment(a)), list(segment(b))
            rouge = (rouge_n(x, y, 1), rouge_n(x, y, 2), rouge_l(x, y)) if x and y else (0.0, 0.0, 0.0)
            out.append([round(v * 100, 4) for v in (*rouge, *([bleu4(a, b)] if bleu else []))])
        return pd.DataFrame(out, columns=names)

    return score(predicted, label)


def credit_mean(grades: Column, hours: Column, points: dict[str, float]) -> Column:
    """Mean of mapped grades weighted by hours, to two places."""
    value = F.create_map(*(F.lit(x) for pair in points.items() for x in pair))
    weighted = F.aggregate(F.zip_with(grades, hours, lambda g, h: F.try_element_at(value, g) * h), F.lit(0.0), lambda a, x: a + x)
    return F.bround(weighted / F.aggregate(hours, F.lit(0.0), lambda a, x: a + x), 2)
