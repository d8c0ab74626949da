"""Losses and rewards of preference tuning over log-probability columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import IGNORE, log_sigmoid


def sequence_logp(logps: Column, labels: Column) -> tuple[Column, Column]:
    """Sum and number of the log-probabilities whose shifted label counts.

    ``logps[i]`` belongs to ``labels[i + 1]``.
    """
    pairs = F.zip_with(logps, F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0))), lambda p, t: F.when(t != IGNORE, p))
    used = F.filter(pairs, lambda p: p.isNotNull())
    return F.aggregate(used, F.lit(0.0), lambda a, p: a + p), F.size(used)


def normalised(logp: Column, length: Column, loss: str) -> Column:
    """Per-token log-probability for the losses that use it."""
    return logp / length if loss in ("ipo", "orpo", "simpo") else logp


def orpo_loss(chosen: Column, rejected: Column, beta: float = 0.1) -> Column:
    odds = (chosen - rejected) - (F.log1p(-F.exp(chosen)) - F.log1p(-F.exp(rejected)))
    return -chosen - beta * log_sigmoid(odds)


def simpo_loss(chosen: Column, rejected: Column, beta: float = 0.1, gamma: float = 0.5) -> Column:
    return -log_sigmoid(beta * ((chosen - rejected) - gamma / beta))


def dpo_loss(chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, kind: str = "sigmoid", beta: float = 0.1, smoothing: float = 0.0) -> Column:
    gap = (chosen - rejected) - (ref_chosen - ref_rejected)
    if kind == "sigmoid":
        return -log_sigmoid(beta * gap) * (1 - smoothing) - log_sigmoid(-beta * gap) * smoothing
    if kind == "hinge":
        return F.greatest(1 - beta * gap, F.lit(0.0))
    if kind == "ipo":
        return F.pow(gap - 1 / (2 * beta), F.lit(2.0))
    if kind == "kto_pair":
        chosen_kl = F.greatest(F.avg(chosen - ref_chosen).over(_whole()), F.lit(0.0))
        rejected_kl = F.greatest(F.avg(rejected - ref_rejected).over(_whole()), F.lit(0.0))
        return (1 - F.exp(log_sigmoid(beta * (chosen - ref_chosen - rejected_kl)))) + (1 - F.exp(log_sigmoid(beta * (chosen_kl - (rejected - ref_rejected)))))
    raise ValueError(f"Unknown loss: {kind}.")


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy("batch")


def uses_reference(stage: str, loss: str) -> bool:
    return stage == "dpo" and loss not in ("orpo", "simpo")


def with_tuning_term(loss: Column, chosen_mean_logp: Column, gamma: float) -> Column:
    """The loss plus a share of the chosen answers' own loss."""
    return loss - gamma * chosen_mean_logp if gamma > 1e-6 else loss


def kto_loss(logp: Column, ref_logp: Column, liked: Column, kl: Column, beta: float = 0.1, liked_weight: float = 1.0, other_weight: float = 1.0) -> Column:
    """Loss of one rated answer, given the batch's estimate of the divergence."""
    gap = logp - ref_logp
    good = liked_weight * (1 - F.exp(log_sigmoid(beta * (gap - kl))))
    bad = other_weight * (1 - F.exp(log_sigmoid(beta * (kl - gap))))
    return F.when(liked, good).otherwise(bad)


def reward_loss(chosen: Column, rejected: Column) -> Column:
    return -log_sigmoid(chosen - rejected)


def reward_summary(rows: DataFrame, group: str | None = None, beta: float = 0.1) -> DataFrame:
    """Mean rewards, accuracy and margin of chosen and rejected answers."""
    chosen, rejected = beta * (F.col("chosen") - F.col("ref_chosen")), beta * (F.col("rejected") - F.col("ref_rejected"))
    parts = [
        F.avg(chosen).alias("rewards_chosen"),
        F.avg(rejected).alias("rewards_rejected"),
        F.avg((chosen > rejected).cast("double")).alias("rewards_accuracy"),
        F.avg(chosen - rejected).alias("rewards_margin"),
        F.avg("chosen").alias("logps_chosen"),
        F.avg("rejected").alias("logps_rejected"),
    ]
    return rows.groupBy(*([group] if group else [])).agg(*parts)


def trim_left(ids: Column, pad: int) -> Column:
    """Without the pads in front."""
    first = F.array_position(F.transform(ids, lambda x: F.when(x != pad, 1).otherwise(0)), F.lit(1))
    return F.when(first > 0, F.slice(ids, first.cast("int"), F.size(ids))).otherwise(F.array().cast("array<int>"))


def trim_right(ids: Column, pad: int, eos: int) -> Column:
    """Without the pads behind; where pad and end are one token, one end stays, and an
    answer without a token keeps one."""
    kept = F.size(ids) - F.coalesce(F.array_position(F.transform(F.reverse(ids), lambda x: F.when(x != pad, 1).otherwise(0)), F.lit(1)).cast("int"), F.lit(0)) + 1
    none = ~F.exists(ids, lambda x: x != pad)
    length = F.when(none, F.lit(1)).otherwise(kept + (1 if pad == eos else 0))
    return F.slice(ids, F.lit(1), F.least(length, F.size(ids)))
