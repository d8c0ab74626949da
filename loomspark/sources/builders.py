"""Builders that turn transcripts and turn lists into conversation rows.

A transcript is cut at its markers; turns are read from the end. Splitting at every marker
gives the pieces in one expression, and the rule "the last asking marker before an answer"
becomes a choice among the pieces, so no Python is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import strip

SAID = "array<struct<from:string,value:string>>"
ASK, ANSWER = "Human:", "Assistant:"
HH_ASK, HH_ANSWER = "\n\nHuman: ", "\n\nAssistant: "


def _said(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("from"), text.alias("value"))


def _pieces(text: Column, ask: str, answer: str) -> Column:
    """(kind, text) of what follows each marker; kind 0 is the text in front."""
    found = F.regexp_extract_all(text, F.lit(f"\\Q{ask}\\E|\\Q{answer}\\E"), F.lit(0))
    parts = F.split(text, f"\\Q{ask}\\E|\\Q{answer}\\E", -1)
    kind = lambda i: F.when(i == 0, 0).when(found[F.greatest(i - 1, F.lit(0))] == ask, 1).otherwise(2)
    return F.when(F.size(found) > 0, F.transform(parts, lambda p, i: F.struct(kind(i).alias("kind"), p.alias("text")))).otherwise(
        F.transform(parts, lambda p: F.struct(F.lit(0).alias("kind"), p.alias("text")))
    )


def _turns(pieces: Column) -> Column:
    """(question, answer) of each asking piece that an answering piece follows."""
    pair = lambda p, i: F.when(
        (p["kind"] == 1) & (F.try_element_at(pieces, i + 2)["kind"] == 2),
        F.struct(strip(p["text"]).alias("question"), strip(F.try_element_at(pieces, i + 2)["text"]).alias("answer")),
    )
    return F.filter(F.transform(pieces, pair), lambda t: t.isNotNull())


def build_transcripts(df: DataFrame, instruction: str = "instruction", output: str = "output", keep: list[str] | None = None) -> DataFrame:
    """``Human:`` / ``Assistant:`` transcripts whose last question the output answers.

    Markers have to alternate, as they do in such transcripts; a question without an answer
    before another question is left out.
    """
    pieces = _pieces(strip(F.col(instruction)), ASK, ANSWER)
    rows = df.withColumn("__pieces", pieces).withColumn("__turns", _turns(F.col("__pieces")))
    asked = F.filter("__pieces", lambda p: p["kind"] == 1)
    # The last question ends at the transcript's last (empty) answer mark.
    last = strip(F.coalesce(F.try_element_at(asked, F.lit(-1))["text"], F.try_element_at(F.col("__pieces"), F.lit(1))["text"]))
    earlier = F.filter("__turns", lambda t: F.lit(True))
    open_end = F.try_element_at(F.col("__pieces"), F.lit(-1))["kind"] == 2
    earlier = F.when(open_end & (F.size("__turns") > 0), F.slice("__turns", F.lit(1), F.size("__turns") - 1)).otherwise(earlier)
    before = F.flatten(F.transform(earlier, lambda t: F.array(_said("human", t["question"]), _said("gpt", t["answer"]))))
    end = F.array(_said("human", last), _said("gpt", strip(F.col(output))))
    return rows.select(*(keep or []), F.concat(before, end).cast(SAID).alias("conversations"))


def build_preferences(df: DataFrame, chosen: str = "chosen", rejected: str = "rejected", keep: list[str] | None = None) -> DataFrame:
    """Chosen and rejected transcripts of one dialogue: instruction, both answers, history."""
    last_answer = lambda c: strip(F.substring_index(F.col(c), HH_ANSWER, -1))
    rows = df.withColumn("__pieces", _pieces(F.col(chosen), HH_ASK, HH_ANSWER)).withColumn("__turns", _turns(F.col("__pieces")))
    history = F.transform(F.slice("__turns", F.lit(1), F.greatest(F.size("__turns") - 1, F.lit(0))), lambda t: F.array(t["question"], t["answer"]))
    asked = F.try_element_at(F.col("__turns"), F.lit(-1))["question"]
    return rows.select(*(keep or []), F.coalesce(asked, F.lit("")).alias("instruction"), last_answer(chosen).alias("chosen"), last_answer(rejected).alias("rejected"), history.alias("history"))


def build_turn_lists(df: DataFrame, data: str = "data", keep: list[str] | None = None) -> DataFrame:
    """Lists of texts that alternate between question and answer; an odd last text is left
    out, and lists of fewer than two texts."""
    even = F.slice(data, F.lit(1), (F.floor(F.size(data) / 2) * 2).cast("int"))
    said = F.transform(even, lambda t, i: F.struct(F.when(i % 2 == 0, "human").otherwise("gpt").alias("from"), t.alias("value")))
    return df.where(F.size(data) >= 2).select(*(keep or []), said.cast(SAID).alias("conversations"))


def parse_turn_lists(lines: DataFrame, column: str = "value") -> DataFrame:
    """Turn lists from JSON lines; lines that aren't JSON are left out."""
    parsed = lines.select(F.from_json(column, "id string, data array<string>", {"mode": "PERMISSIVE"}).alias("j"))
    return build_turn_lists(parsed.where("j.data is not null").select("j.id", "j.data"), keep=["id"])
