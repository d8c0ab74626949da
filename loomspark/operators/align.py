"""Alignment of instruction and conversation rows to the canonical chat row."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.lineage import cut_lineage
from loomspark.sources.catalog import DatasetSpec

MESSAGES = "array<struct<role:string,content:string>>"
CANONICAL = ("_prompt", "_response", "_system", "_tools", "_images", "_videos", "_audios")


def message(role: str | Column, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.cast("string").alias("content"))


def no_messages() -> Column:
    return F.array().cast(MESSAGES)


def media(df: DataFrame, name: str | None) -> Column:
    """A list of references (or a single one); empty lists are null."""
    if not name:
        return F.lit(None).cast("array<string>")
    value = F.col(name)
    if not df.schema[name].dataType.typeName() == "array":
        value = F.array(value)
    refs = F.filter(value, lambda m: m.isNotNull())
    return F.when(F.size(refs) > 0, refs)


def with_paths(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Canonical rows whose media references that ``files`` (name, path) lists are paths.

    References are taken apart, joined to the listing and put back in their order; rows without
    media stay out of it.
    """
    kinds = ("_images", "_videos", "_audios")
    held = cut_lineage(rows.withColumn("__row", F.monotonically_increasing_id()))
    one = lambda k: F.coalesce(F.transform(k, lambda r, i: F.struct(F.lit(k).alias("kind"), i.alias("at"), r.alias("name"))), F.array().cast("array<struct<kind:string,at:int,name:string>>"))
    refs = held.select("__row", F.inline(F.concat(*(one(k) for k in kinds))))
    listed = files.select("name", "path").dropDuplicates(["name"])
    found = refs.join(listed, "name", "left").select("__row", "kind", "at", F.coalesce("path", "name").alias("path"))
    lists = {k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("at", "path")))), lambda x: x["path"]) for k in kinds}
    put = found.groupBy("__row").agg(*(c.alias(f"_{k}") for k, c in lists.items()))
    made = held.join(put, "__row", "left")
    return made.select(*(F.when(F.size(f"_{c}") > 0, F.col(f"_{c}")).alias(c) if c in kinds else F.col(c) for c in rows.columns))


def rest(df: DataFrame, spec: DatasetSpec, system: Column) -> list[Column]:
    tools = F.col(spec.tools).cast("string") if spec.tools else F.lit("")
    refs = [media(df, getattr(spec, kind)).alias(f"_{kind}") for kind in ("images", "videos", "audios")]
    return [system.alias("_system"), tools.alias("_tools"), *refs]


def twins(answer: Column, tag: Column) -> Column:
    """A rated answer beside an empty one: first if it was liked, second if not."""
    empty = message("assistant", F.lit(""))
    return F.when(tag, F.array(answer, empty)).otherwise(F.array(empty, answer)).cast(MESSAGES)


def align_alpaca(df: DataFrame, spec: DatasetSpec, keep: list[str]) -> DataFrame:
    types = dict(df.dtypes)
    asked = [F.nullif(F.col(c), F.lit("")) for c in (spec.prompt, spec.query) if c]
    ask = F.array(message("user", F.concat_ws("\n", *asked)))
    prompt = ask.cast(MESSAGES)
    if spec.history and types[spec.history].startswith("array"):
        pairs = F.transform(F.col(spec.history), lambda h: F.array(message("user", h[0]), message("assistant", h[1])))
        prompt = F.concat(F.coalesce(F.flatten(pairs).cast(MESSAGES), no_messages()), prompt)
    response = no_messages()
    if spec.response:
        answer = message("assistant", F.col(spec.response))
        response = F.when(F.col(spec.response).isNotNull(), F.array(answer).cast(MESSAGES)).otherwise(response)
    if spec.ranking and spec.chosen and spec.rejected:
        both = F.array(message("assistant", F.col(spec.chosen)), message("assistant", F.col(spec.rejected))).cast(MESSAGES)
        response = F.when(F.col(spec.chosen).isNotNull() & F.col(spec.rejected).isNotNull(), both).otherwise(response)
    if spec.kto_tag and types[spec.kto_tag] == "boolean":
        rated = twins(message("assistant", F.col(spec.response)), F.col(spec.kto_tag))
        response = F.when(F.col(spec.kto_tag).isNotNull(), rated).otherwise(response)
    system = F.col(spec.system).cast("string") if spec.system else F.lit("")
    return df.select(*keep, prompt.alias("_prompt"), response.alias("_response"), *rest(df, spec, system))


def align_sharegpt(df: DataFrame, spec: DatasetSpec, keep: list[str]) -> DataFrame:
    """Broken conversations (a wrong role for its place, a wrong parity) get empty lists.

    A chosen or rejected message of an unknown role also makes the row broken.
    """
    types = dict(df.dtypes)
    roles = {spec.user_tag: "user", spec.assistant_tag: "assistant", spec.observation_tag: "observation", spec.function_tag: "function", spec.system_tag: "system"}
    roles = {tag: role for tag, role in roles.items() if tag}
    mapped = F.create_map(*(F.lit(x) for pair in roles.items() for x in pair))
    asks = [t for t in (spec.user_tag, spec.observation_tag) if t]
    answers = [t for t in (spec.assistant_tag, spec.function_tag) if t]
    given = F.coalesce(F.col(spec.messages), F.array().cast(types[spec.messages]))

    def align(m: Column) -> Column:
        return message(F.try_element_at(mapped, m[spec.role_tag]), m[spec.content_tag])

    system = F.col(spec.system).cast("string") if spec.system else F.lit("")
    turns = given
    if spec.system_tag:
        first = F.try_element_at(given, F.lit(1))
        lifted = F.coalesce(first[spec.role_tag] == spec.system_tag, F.lit(False))
        turns = F.when(lifted, F.slice(given, F.lit(2), F.greatest(F.size(given) - 1, F.lit(0)))).otherwise(given)
        system = F.when(lifted, first[spec.content_tag].cast("string")).otherwise(system)
    rows = df.withColumns({"__turns": turns, "__system": system})
    wrong = F.exists(
        F.transform("__turns", lambda m, i: F.when(i % 2 == 0, m[spec.role_tag].isin(asks)).otherwise(m[spec.role_tag].isin(answers))),
        lambda ok: ~F.coalesce(ok, F.lit(False)),
    )
    size = F.size("__turns")
    broken = wrong | (size % 2 != (1 if spec.ranking else 0))
    aligned = F.transform("__turns", align)
    before, last = F.slice(aligned, F.lit(1), F.greatest(size - 1, F.lit(0))), F.slice(aligned, F.greatest(size, F.lit(1)), F.lit(1))
    prompt, response = before, last
    if spec.ranking and spec.chosen and spec.rejected:
        chosen, rejected = F.col(spec.chosen), F.col(spec.rejected)
        both = chosen.isNotNull() & rejected.isNotNull()
        unknown = F.try_element_at(mapped, chosen[spec.role_tag]).isNull() | F.try_element_at(mapped, rejected[spec.role_tag]).isNull()
        broken = broken | (both & unknown)
        prompt = F.when(both, aligned).otherwise(prompt)
        response = F.when(both, F.array(align(chosen), align(rejected))).otherwise(response)
    if spec.kto_tag and types[spec.kto_tag] == "boolean":
        tag = F.col(spec.kto_tag)
        empty = F.array(message("assistant", F.lit("")))
        rated = F.when(tag, F.concat(last, empty)).otherwise(F.concat(empty, last))
        prompt = F.when(tag.isNotNull(), before).otherwise(prompt)
        response = F.when(tag.isNotNull(), rated).otherwise(response)
    return rows.select(
        *keep,
        F.when(broken, no_messages()).otherwise(prompt).cast(MESSAGES).alias("_prompt"),
        F.when(broken, no_messages()).otherwise(response).cast(MESSAGES).alias("_response"),
        *rest(rows, spec, F.col("__system")),
    )


ALIGNERS: dict[str, Callable[..., DataFrame]] = {"alpaca": align_alpaca, "sharegpt": align_sharegpt}


def register_aligner(name: str, aligner: Callable[..., DataFrame]) -> None:
    """Add an aligner ``(df, spec, keep)`` for a formatting name.

    One that takes a fourth argument gets the listing of media files (or None) and turns
    references into paths itself.
    """
    if name in ALIGNERS:
        raise ValueError(f"An aligner named {name} exists already.")
    ALIGNERS[name] = aligner


def align(df: DataFrame, spec: DatasetSpec, keep: list[str] | None = None, media_files: DataFrame | None = None) -> DataFrame:
    """Canonical rows; ``keep`` names columns (an ordinal, say) to carry along, ``media_files``
    is a listing (name, path) of media files, whose references become paths."""
    if spec.formatting not in ALIGNERS:
        raise ValueError(f"There is no aligner named {spec.formatting}.")
    aligner = ALIGNERS[spec.formatting]
    if len(inspect.signature(aligner).parameters) > 3:
        return aligner(df, spec, keep or [], media_files)
    rows = aligner(df, spec, keep or [])
    return rows if media_files is None else with_paths(rows, media_files)


def valid_for(stage: str) -> Column:
    """Rows that a stage can use: an odd prompt and the number of responses that it needs."""
    odd = F.size("_prompt") % 2 == 1
    if stage == "pt":
        return F.size("_prompt") > 0
    if stage == "sft":
        return odd & (F.size("_response") == 1)
    if stage in ("rm", "dpo", "kto"):
        return odd & (F.size("_response") >= 2)
    return odd
