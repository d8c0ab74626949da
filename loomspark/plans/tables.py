"""How the test tables become inputs of the operators, in DataFrame code and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators.align import align
from loomspark.sources.catalog import DatasetSpec

CHAT = DatasetSpec(
    "conversations",
    formatting="sharegpt",
    messages="messages",
    role_tag="role",
    content_tag="text",
    user_tag="user",
    assistant_tag="assistant",
    observation_tag="observation",
    function_tag="function",
    system_tag="system",
)
RANKED = DatasetSpec(**{**CHAT.__dict__, "ranking": True, "chosen": "chosen", "rejected": "rejected"})
CUTOFF, BATCH = 1024, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id and its messages by turn."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    return grouped.select("conv_id", F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("messages"))


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(chats(spark, sf_dir), CHAT, keep=["conv_id"])


def answer(prefix: str) -> Column:
    last = F.try_element_at(F.col("messages"), F.lit(-1))["text"]
    return F.struct(F.lit("assistant").alias("role"), F.concat(F.lit(prefix), last).alias("text"))


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that end with a question, with two made-up answers."""
    rows = chats(spark, sf_dir).withColumns({"chosen": answer("Yes. "), "rejected": answer("No. ")})
    return align(rows, RANKED, keep=["conv_id"])


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as rated answers: the source asks, the text answers."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    spec = DatasetSpec("rated", prompt="source", query="lang", response="text", kto_tag="liked")
    return align(docs.join(labels, "doc_id").withColumn("liked", F.col("quality") == 1), spec, keep=["doc_id"])


#: conversations as SQL: v(conv_id, system, m, n, ok).
V = """
WITH t AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn) AS l FROM conversations GROUP BY conv_id),
c AS (SELECT conv_id, CASE WHEN l[1].role = 'system' THEN l[1].text ELSE '' END AS system,
  CASE WHEN l[1].role = 'system' THEN l[2:] ELSE l END AS m FROM t),
v AS (SELECT conv_id, system, m, len(m) AS n,
  len(list_filter(range(1, len(m) + 1), lambda i: m[i].role <> CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END)) = 0 AS ok FROM c)
"""


def ids_sql(text: str) -> str:
    """The character ids of a text, each with a comma behind it."""
    return f"CASE WHEN length({text}) > 0 THEN array_to_string(list_transform(string_split({text}, ''), lambda c: unicode(c)), ',') || ',' ELSE '' END"


def ids_md5_sql(joined: str) -> str:
    return f"md5(rtrim({joined}, ','))"


def seqlen_sql(s: str, t: str, cut: str) -> tuple[str, str]:
    """Kept source and target lengths as SQL."""
    most = f"CASE WHEN {t} * 2 < {cut} THEN {cut} WHEN {s} * 2 < {cut} THEN {cut} - {s} ELSE CAST(trunc({cut} * (CAST({t} AS DOUBLE) / ({s} + {t}))) AS BIGINT) END"
    target = f"least({most}, {t})"
    return f"least(greatest({cut} - {target}, 0), {s})", target


NL = "chr(10)"
#: How the chatml format writes a system text, a question and an answer, as SQL.
SYSTEM = f"CASE WHEN system <> '' THEN '<|im_start|>system' || {NL} || system || '<|im_end|>' || {NL} ELSE '' END"
USER = f"'<|im_start|>user' || {NL} || {{text}} || '<|im_end|>' || {NL} || '<|im_start|>assistant' || {NL}"
ANSWER = f"{{text}} || '<|im_end|>' || {NL}"


def sft_sql(reverse: bool = False, system: str = SYSTEM, asked: str = "m[2*i-1].text", answered: str = "m[2*i].text", cutoff: int = CUTOFF) -> str:
    """conv_id, n_input, n_target, ids and labels (joined by commas) of supervised rows.

    Pairs are rendered as chatml and cut to the budget one after the other, from the last one
    on if ``reverse``, when only the last answer is learned.
    """
    s, t = seqlen_sql("length(x.source)", "length(x.target)", f"({cutoff} - f.total)")
    learned = f"CASE WHEN f.k = 1 THEN {ids_sql('kept_target')} ELSE repeat('-100,', f.t) END" if reverse else ids_sql("kept_target")
    target = "CASE WHEN f.k = 1 THEN f.t ELSE 0 END" if reverse else "f.t"
    return (
        "WITH RECURSIVE"
        + V.strip()[4:]
        + f""", s AS (SELECT conv_id, i, CASE WHEN i = 1 THEN {system} ELSE '' END || {USER.format(text=asked)} AS source, {ANSWER.format(text=answered)} AS target
  FROM (SELECT *, unnest(range(1, n // 2 + 1)) AS i FROM v WHERE ok AND n % 2 = 0 AND n > 0)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY {'-i' if reverse else 'i'}) AS k FROM s),
f AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS t FROM o
  UNION ALL SELECT f.conv_id, x.k, CAST(f.total + {s} + {t} AS BIGINT), CAST({s} AS BIGINT), CAST({t} AS BIGINT) FROM f JOIN o x ON x.conv_id = f.conv_id AND x.k = f.k + 1 WHERE f.total < {cutoff}),
w AS (SELECT f.*, o.i, substring(o.source, 1, f.s) AS kept_source, substring(o.target, 1, f.t) AS kept_target FROM f JOIN o USING (conv_id, k))
SELECT conv_id, CAST(sum(f.s + f.t) AS BIGINT) AS n_input, CAST(sum({target}) AS BIGINT) AS n_target,
  string_agg({ids_sql('kept_source')} || {ids_sql('kept_target')}, '' ORDER BY i) AS ids, string_agg(repeat('-100,', f.s) || {learned}, '' ORDER BY i) AS labels FROM w f GROUP BY conv_id"""
    )


def sft_digest_sql(**given) -> str:
    return f"SELECT conv_id, n_input, n_input AS n_labels, n_target, {ids_md5_sql('ids')} AS ids_md5, {ids_md5_sql('labels')} AS labels_md5 FROM ({sft_sql(**given)})"
