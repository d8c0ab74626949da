"""Few-shot benchmark prompts and their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The prompt formats by language.
PROMPTS = {
    "en": ("The following are multiple choice questions (with answers) about {subject}.\n\n", "\n{choice}. {content}", "\nAnswer:"),
    "zh": ("以下是中国关于{subject}考试的单项选择题，请选出其中的正确答案。\n\n", "\n{choice}. {content}", "\n答案："),
}
CHOICES = "ABCD"


def register_prompt(name: str, system: str, choice: str, answer: str) -> None:
    if name in PROMPTS:
        raise ValueError(f"A prompt format named {name} exists already.")
    PROMPTS[name] = (system, choice, answer)


def task_of(name: str) -> tuple[str, str]:
    """Suite and split of a task name such as ``mmlu_test``."""
    suite, _, part = name.partition("_")
    return suite, part


def question_text(columns: dict[str, Column], language: str = "en") -> Column:
    """The question, the choices that are there, and the answer mark."""
    _, choice, answer = PROMPTS[language]
    parts = [columns["question"]]
    for letter in CHOICES:
        if letter in columns:
            before, after = choice.replace("{choice}", letter).split("{content}")
            text = F.concat(F.lit(before), columns[letter], F.lit(after))
            parts.append(F.coalesce(text, F.lit("")))
    return F.concat(*parts, F.lit(answer))


def header(subject: Column, language: str = "en") -> Column:
    before, after = PROMPTS[language][0].split("{subject}")
    return F.concat(F.lit(before), subject, F.lit(after))


def prompts(shots: DataFrame, group: list[str], order: str, language: str = "en") -> DataFrame:
    """Messages of each item: its shots as question and answer turns, the header in front.

    ``shots`` has a row for each shot and one for the item itself, in ``order``, with columns
    subject, prompt and answer.
    """
    turn = F.struct(F.col(order).alias("o"), F.col("prompt").alias("prompt"), F.col("answer").alias("answer"))
    held = shots.groupBy(*group, "subject").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    say = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    pair = lambda t, i: F.array(say("user", F.when(i == 0, F.concat(header(F.col("subject"), language), t["prompt"])).otherwise(t["prompt"])), say("assistant", t["answer"]))
    return held.select(*group, "subject", F.flatten(F.transform("t", pair)).alias("messages"))


def results_by_subject(rows: DataFrame, subject: str, index: str, predicted: str) -> DataFrame:
    """One row a subject with a map from item to prediction."""
    return rows.groupBy(subject).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(index).cast("string"), predicted)))).alias("results"))


def report(scores: DataFrame) -> str:
    """The text of a category report, in the fixed order; ``scores`` has one row a category."""
    from loomspark.operators.metrics import CATEGORIES

    found = {r["category"]: r["accuracy"] for r in scores.select("category", "accuracy").collect()}
    return "\n".join(f"{c:>15}: {found[c]:.2f}" for c in CATEGORIES if c in found)
