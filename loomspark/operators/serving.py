"""Requests and responses in the chat-completion shape, as table operators."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from loomspark.operators.multimodal import IMAGE

#: The request fields that are read.
REQUEST = (
    "struct<model:string,messages:array<struct<role:string,content:string,tool_calls:array<struct<id:string,type:string,"
    "function:struct<name:string,arguments:string>>>>>,tools:string,n:int,stream:boolean>"
)
PARTS = "array<struct<type:string,text:string,image_url:struct<url:string>>>"


def parse_requests(text: Column) -> Column:
    return F.from_json(text, REQUEST)


def parts_text(content: Column) -> Column:
    """A message's text; of a list of parts their texts, an image being a placeholder."""
    parts = F.from_json(content, PARTS)
    joined = F.array_join(F.transform(parts, lambda p: F.when(p["type"] == "text", F.coalesce(p["text"], F.lit(""))).otherwise(F.lit(IMAGE))), "")
    return F.when(content.startswith("["), F.coalesce(joined, content)).otherwise(F.coalesce(content, F.lit("")))


def part_images(content: Column) -> Column:
    parts = F.when(content.startswith("["), F.from_json(content, PARTS))
    return F.coalesce(F.transform(F.filter(parts, lambda p: p["type"] == "image_url"), lambda p: p["image_url"]["url"]), F.array().cast("array<string>"))


def calls_json(calls: Column) -> Column:
    """Tool calls as the JSON text of a function message."""
    one = lambda c: F.concat(F.lit('{"name": "'), c["function"]["name"], F.lit('", "arguments": '), c["function"]["arguments"], F.lit("}"))
    return F.concat(F.lit("["), F.array_join(F.transform(calls, one), ", "), F.lit("]"))


def normalise(requests: DataFrame, request: str = "request") -> DataFrame:
    """Add system, messages (canonical roles), images, tools and whether the request is valid.

    Valid requests have messages, an odd number of them after a leading system message, and
    user or tool messages in turn with answers.
    """
    given = F.coalesce(F.col(f"{request}.messages"), F.array().cast("array<struct<role:string,content:string,tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>>>"))
    first = F.try_element_at(given, F.lit(1))
    lifted = F.coalesce(first["role"] == "system", F.lit(False))
    rows = requests.withColumns(
        {
            "system": F.when(lifted, parts_text(first["content"])),
            "__turns": F.when(lifted, F.slice(given, F.lit(2), F.greatest(F.size(given) - 1, F.lit(0)))).otherwise(given),
            "tools": F.col(f"{request}.tools"),
        }
    )

    def turn(m: Column) -> Column:
        called = F.coalesce(F.size(m["tool_calls"]), F.lit(-1)) > 0
        role = F.when((m["role"] == "assistant") & called, "function").when(m["role"] == "tool", "observation").otherwise(m["role"])
        return F.struct(role.alias("role"), F.when((m["role"] == "assistant") & called, calls_json(m["tool_calls"])).otherwise(parts_text(m["content"])).alias("content"))

    wrong = F.exists(F.transform("__turns", lambda m, i: F.when(i % 2 == 0, m["role"].isin("user", "tool")).otherwise(m["role"].isin("assistant", "function"))), lambda ok: ~F.coalesce(ok, F.lit(False)))
    return rows.withColumns(
        {
            "messages": F.transform("__turns", turn),
            "images": F.flatten(F.transform("__turns", lambda m: part_images(m["content"]))),
            "valid": (F.size("__turns") % 2 == 1) & ~wrong,
        }
    ).drop("__turns")


def image_bytes(url: Column) -> Column:
    """Bytes of a base64 data address; null for other addresses."""
    data = F.regexp_extract(url, r"^data:image/(png|jpg|jpeg|gif|bmp);base64,(.+)$", 2)
    return F.when(data != "", F.unbase64(data))


def response_length(ids: Column, eos: int) -> tuple[Column, Column]:
    """Tokens up to and with the end, and why the answer stopped."""
    at = F.array_position(ids, F.lit(eos)).cast("int")
    return F.when(at > 0, at).otherwise(F.size(ids)), F.when(at > 0, "stop").otherwise("length")


def usage(answers: DataFrame, request_id: str) -> DataFrame:
    """Token usage of each request: one prompt, all its answers."""
    out = answers.groupBy(request_id).agg(F.max("prompt_length").alias("prompt_tokens"), F.sum("response_length").alias("completion_tokens"))
    return out.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def finish_reason(calls: Column, reason: Column) -> Column:
    return F.when(calls.isNotNull(), "tool_calls").otherwise(reason)


def check_stream(tools: bool, n: int) -> None:
    if tools:
        raise ValueError("A stream can't return tool calls.")
    if n > 1:
        raise ValueError("A stream has one answer only.")


def deltas(texts: DataFrame, request_id: str, order: str, text: str = "text") -> DataFrame:
    """What each growing text adds to the one before, and a closing mark."""
    before = F.lag(text, 1, "").over(Window.partitionBy(request_id).orderBy(order))
    rows = texts.select(request_id, F.col(order).cast("long").alias(order), F.substring(F.col(text), F.length(before) + 1, F.length(text)).alias("delta"))
    rows = rows.where("delta <> ''")
    last = texts.groupBy(request_id).agg((F.max(order) + 1).cast("long").alias(order)).withColumn("delta", F.lit("[DONE]"))
    return rows.unionByName(last)


def think_parts(text: Column, marks: tuple[str, str] = ("<think>", "</think>")) -> tuple[Column, Column]:
    """Thought and answer of a text; without a closing mark everything after the opening is thought."""
    opened = text.startswith(marks[0])
    bare = F.replace(text, F.lit(marks[0]), F.lit(""))
    pieces = F.split(bare, f"\\Q{marks[1]}\\E", 2)
    return F.when(opened, pieces[0]), F.when(opened, F.coalesce(F.try_element_at(pieces, F.lit(2)), F.lit(""))).otherwise(text)


def valid_tools(text: Column) -> Column:
    """Whether a text is a JSON list whose items all have a name."""
    items = F.from_json(text, "array<struct<name:string>>")
    return F.coalesce(text.startswith("[") & ~F.exists(items, lambda t: t["name"].isNull()), F.lit(False))


def responses(answers: DataFrame, tool_format: str, text: str = "text", reason: str = "reason") -> DataFrame:
    """Answers with their tool calls taken out of the text, and why each one finished."""
    from loomspark.operators.tools import extract_calls

    rows = answers.withColumn("tool_calls", extract_calls(F.col(text), tool_format))
    return rows.withColumns({"content": F.when(F.col("tool_calls").isNull(), F.col(text)), "finish_reason": finish_reason(F.col("tool_calls"), F.col(reason))})


def scored(rows: DataFrame, text: str, scorer: Callable[[list[str]], list[float]], name: str = "score", batch: int = 64) -> DataFrame:
    """Add scores of texts from a client, such as a reward service, called by batch.

    ``scorer`` runs in the executors and has to be picklable; none is built in.
    """

    @pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        values = column.fillna("").tolist()
        return pd.Series([float(x) for at in range(0, len(values), batch) for x in scorer(values[at : at + batch])])

    return rows.withColumn(name, score(F.col(text)))
