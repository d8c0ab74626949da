"""Writing tokenized datasets, predictions, scores and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import IGNORE


def write_tokenized(splits: dict[str, DataFrame], path: str, streaming: bool = False) -> None:
    """Each split as a Parquet folder; an existing one is never overwritten."""
    if streaming:
        raise ValueError("A streamed dataset can't be saved.")
    for name, df in splits.items():
        df.write.mode("errorifexists").parquet(f"{path.rstrip('/')}/split={name}")


def pads_last(ids: Column, pad: int) -> Column:
    """Leading pads moved behind the rest."""
    first = F.array_position(F.transform(ids, lambda x: F.when(x != pad, 1).otherwise(0)), F.lit(1)).cast("int")
    return F.when(first > 1, F.concat(F.slice(ids, first, F.size(ids)), F.slice(ids, F.lit(1), first - 1))).otherwise(ids)


def without_ignored(labels: Column, pad: int | None = None) -> Column:
    """Labels without the ignored ones, or with pads in their place."""
    if pad is None:
        return F.filter(labels, lambda x: x != IGNORE)
    return F.transform(labels, lambda x: F.when(x == IGNORE, pad).otherwise(x))


def char_text(ids: Column, special: int = 0x110000) -> Column:
    """Text of character ids; special ids have none."""
    return F.array_join(F.transform(F.filter(ids, lambda x: (x >= 0) & (x < special)), lambda x: F.decode(F.unhex(F.lpad(F.hex(x), 8, "0")), "UTF-32")), "")


def write_predictions(rows: DataFrame, path: str) -> None:
    """JSON lines of prompt, predict and label."""
    rows.select("prompt", "predict", "label").write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def write_pair_scores(rows: DataFrame, path: str) -> None:
    """JSON lines of chosen and rejected scores to two places."""
    pair_scores(rows).write.mode("errorifexists").json(path)


def pair_scores(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    return rows.select(*(keep or []), F.bround("chosen", 2).alias("chosen"), F.bround("rejected", 2).alias("rejected"))


def write_eval_results(results: DataFrame, report: str, path: str) -> None:
    """Predictions by subject as JSON and the report's text; the folder must not exist."""
    results.write.mode("errorifexists").json(f"{path.rstrip('/')}/results.json")
    results.sparkSession.createDataFrame([(report,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path.rstrip('/')}/results.log")


def write_perplexities(rows: DataFrame, path: str) -> None:
    rows.select("perplexity").write.mode("errorifexists").json(path)


def append_log(records: DataFrame, path: str) -> None:
    """Append records as JSON lines, leaving out what is null."""
    records.write.mode("append").json(path)


def command_settings(settings: dict) -> dict:
    """Settings worth writing down: those that are set, and whether to pack."""
    return {k: v for k, v in settings.items() if k == "packing" or not (v is None or v is False or v == "")}


def joined_predictions(prompts: DataFrame, predictions: DataFrame, labels: DataFrame, rid: str = "rid") -> DataFrame:
    """Prompt, prediction and label of each row, joined by the row's number, never by position."""
    return prompts.select(rid, "prompt").join(predictions.select(rid, "predict"), rid).join(labels.select(rid, "label"), rid)
