"""Queries of alignment, rendering and stage processing, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.text import EOS_ID, IGNORE, PAD_ID
from loomspark.operators import collate, stages
from loomspark.operators.align import align, valid_for
from loomspark.operators.chat_markup import compile_template
from loomspark.operators.templates import ChatTokenizer, TEMPLATES, encoded, jinja_template, one_turn, template_from_source, text_target, turn_pairs
from loomspark.operators.tools import QWEN_PROMPT
from loomspark.plans.tables import ANSWER, BATCH, CUTOFF, NL, SYSTEM, USER, V, canonical, chats, ids_md5_sql, ids_sql, ranked, rated, seqlen_sql, sft_digest_sql, sft_sql, table
from loomspark.sources.builders import build_turn_lists
from loomspark.sources.catalog import DatasetSpec

CHATML = TEMPLATES["chatml"]
#: The test tables hold neither tools nor function messages, so these stages need no Python.
NO_TOOLS = {"tools_date": None}


def joined_text(messages):
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")


def long(column, name):
    return column.cast("long").alias(name)


def ids_md5(column, name):
    """A digest of ids in their order."""
    return F.md5(F.array_join(column, ",")).alias(name)


def learned(labels):
    return F.size(F.array_remove(labels, IGNORE))


def sft_digests(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*keep, "conv_id", long(F.size("input_ids"), "n_input"), long(F.size("labels"), "n_labels"), long(learned("labels"), "n_target"), ids_md5("input_ids", "ids_md5"), ids_md5("labels", "labels_md5"))


def sg_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = canonical(spark, sf_dir)
    return rows.select("conv_id", long(F.size("_prompt"), "n_prompt"), long(F.size("_response"), "n_response"), F.md5("_system").alias("system_md5"), F.md5(joined_text("_prompt")).alias("prompt_md5"), F.md5(joined_text("_response")).alias("response_md5"))


SG_ALIGN = (
    V
    + """, g AS (SELECT conv_id, system, n, CASE WHEN ok AND n % 2 = 0 THEN m ELSE [] END AS m FROM v)
SELECT conv_id, CAST(greatest(len(m) - 1, 0) AS BIGINT) AS n_prompt, CAST(CASE WHEN len(m) > 0 THEN 1 ELSE 0 END AS BIGINT) AS n_response,
  md5(system) AS system_md5,
  md5(coalesce(array_to_string(list_transform(m[:-2], lambda x: x.role || ':' || x.text), '|'), '')) AS prompt_md5,
  md5(CASE WHEN len(m) > 0 THEN m[-1].role || ':' || m[-1].text ELSE '' END) AS response_md5
FROM g
"""
)


def sg_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranked(spark, sf_dir).where(valid_for("rm"))
    return rows.select("conv_id", long(F.size("_prompt"), "n_prompt"), F.md5(joined_text("_prompt")).alias("prompt_md5"), F.md5(joined_text("_response")).alias("response_md5"))


SG_PAIR = (
    V
    + """SELECT conv_id, CAST(n AS BIGINT) AS n_prompt,
  md5(array_to_string(list_transform(m, lambda x: x.role || ':' || x.text), '|')) AS prompt_md5,
  md5('assistant:Yes. ' || m[-1].text || '|assistant:No. ' || m[-1].text) AS response_md5
FROM v WHERE ok AND n % 2 = 1"""
)


def flt_sft(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = canonical(spark, sf_dir)
    return rows.agg(long(F.count(F.lit(1)), "n_rows"), long(F.count_if(valid_for("sft")), "n_valid"), long(F.sum(F.when(valid_for("sft"), F.size("_prompt")).otherwise(0)), "n_messages"))


FLT_SFT = V + "SELECT count(*) AS n_rows, count(*) FILTER (ok AND n % 2 = 0 AND n > 0) AS n_valid, CAST(coalesce(sum(n - 1) FILTER (ok AND n % 2 = 0 AND n > 0), 0) AS BIGINT) AS n_messages FROM v"


def jn_role_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of aligned messages, system texts aside, of all conversations whose roles are in turn."""
    rows = canonical(spark, sf_dir).select(F.explode(F.concat("_prompt", "_response")).alias("m"))
    return rows.groupBy(F.col("m.role").alias("role")).agg(long(F.count(F.lit(1)), "n"), long(F.sum(F.length("m.content")), "chars"))


JN_ROLE_MAP = V + "SELECT x.role AS role, count(*) AS n, CAST(sum(length(x.text)) AS BIGINT) AS chars FROM (SELECT unnest(m) AS x FROM v WHERE ok AND n % 2 = 0) GROUP BY 1"


def alpaca_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = DatasetSpec("docs", prompt="source", query="lang", response="text")
    rows = align(table(spark, sf_dir, "documents"), spec, keep=["doc_id"])
    return rows.select("doc_id", F.col("_prompt")[0]["content"].alias("question"), F.md5(F.col("_response")[0]["content"]).alias("answer_md5"), long(F.size("_response"), "n_response"))


ALPACA_PROMPT = "SELECT doc_id, concat_ws(chr(10), nullif(source, ''), nullif(lang, '')) AS question, md5(text) AS answer_md5, CAST(1 AS BIGINT) AS n_response FROM documents"


def alpaca_kto(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rated(spark, sf_dir)
    return rows.select("doc_id", long(F.length(F.col("_response")[0]["content"]), "first_chars"), long(F.length(F.col("_response")[1]["content"]), "second_chars"))


ALPACA_KTO = """SELECT doc_id, CAST(CASE WHEN quality = 1 THEN length(text) ELSE 0 END AS BIGINT) AS first_chars,
  CAST(CASE WHEN quality = 1 THEN 0 ELSE length(text) END AS BIGINT) AS second_chars FROM documents JOIN labels USING (doc_id)"""


def rendered(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = canonical(spark, sf_dir).where(valid_for("sft"))
    made = encoded(F.concat("_prompt", "_response"), TEMPLATES[name], text_target(), F.col("_system"), F.lit(""))
    rows = rows.withColumn("pieces", made)
    prompt, response = one_turn(F.col("pieces"))
    text = F.array_join("pieces", "")
    return rows.select("conv_id", F.md5(text).alias("text_md5"), long(F.length(text), "chars"), long(F.length(F.array_join(prompt, "")), "prompt_chars"), long(F.length(response), "response_chars"), long(F.size(turn_pairs(F.col("pieces"))), "pairs"))


def rendered_sql(first: str, user: str, assistant: str) -> str:
    """SQL of a rendering: expressions over system, x (a message) and i (its number from 1)."""
    return (
        V
        + f""", w AS (SELECT conv_id, n, i, CASE WHEN i = 1 THEN {first} ELSE '' END || CASE WHEN i % 2 = 1 THEN {user} ELSE {assistant} END AS piece
  FROM (SELECT conv_id, n, system, i, m[i] AS x FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM v WHERE ok AND n % 2 = 0 AND n > 0)))
SELECT conv_id, md5(string_agg(piece, '' ORDER BY i)) AS text_md5, CAST(sum(length(piece)) AS BIGINT) AS chars,
  CAST(sum(length(piece)) FILTER (i < n) AS BIGINT) AS prompt_chars, CAST(sum(length(piece)) FILTER (i = n) AS BIGINT) AS response_chars,
  CAST(max(n) // 2 AS BIGINT) AS pairs FROM w GROUP BY conv_id"""
    )


TPL_SQL = {
    "chatml": rendered_sql(
        f"CASE WHEN system <> '' THEN '<|im_start|>system' || {NL} || system || '<|im_end|>' || {NL} ELSE '' END",
        f"'<|im_start|>user' || {NL} || x.text || '<|im_end|>' || {NL} || '<|im_start|>assistant' || {NL}",
        f"x.text || '<|im_end|>' || {NL}",
    ),
    "llama3": rendered_sql(
        f"'<s>' || CASE WHEN system <> '' THEN '<|start_header_id|>system<|end_header_id|>' || {NL} || {NL} || system || '<|eot_id|>' ELSE '' END",
        f"'<|start_header_id|>user<|end_header_id|>' || {NL} || {NL} || x.text || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || {NL} || {NL}",
        "x.text || '<|eot_id|>'",
    ),
    "llama2": rendered_sql(
        "''",
        f"'<s>[INST] ' || CASE WHEN i = 1 AND system <> '' THEN '<<SYS>>' || {NL} || system || {NL} || '<</SYS>>' || {NL} || {NL} ELSE '' END || x.text || ' [/INST]'",
        "x.text || '</s>'",
    ),
    "default": rendered_sql(f"CASE WHEN system <> '' THEN 'System: ' || system || {NL} ELSE '' END", f"'Human: ' || x.text || {NL} || 'Assistant:'", f"x.text || '</s>' || {NL}"),
    "qwen": rendered_sql(
        f"'<|im_start|>system' || {NL} || CASE WHEN system <> '' THEN system ELSE 'You are a helpful assistant.' END || '<|im_end|>' || {NL}",
        f"'<|im_start|>user' || {NL} || x.text || '<|im_end|>' || {NL} || '<|im_start|>assistant' || {NL}",
        f"x.text || '<|im_end|>' || {NL}",
    ),
    "chatglm2": rendered_sql(
        "'[gMASK]sop' || system",
        f"'[Round ' || ((i - 1) // 2) || ']' || {NL} || {NL} || '问：' || x.text || {NL} || {NL} || '答：'",
        "x.text",
    ),
}


def prc_sft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sft_digests(stages.process_sft(canonical(spark, sf_dir), CHATML, CUTOFF, keep=["conv_id"], **NO_TOOLS))


PRC_SFT = sft_digest_sql()


def prc_sft_mask_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sft_digests(stages.process_sft(canonical(spark, sf_dir), CHATML, CUTOFF, keep=["conv_id"], mask_history=True, **NO_TOOLS))


PRC_SFT_MASK_HISTORY = sft_digest_sql(reverse=True)


def prc_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two in three conversations come with a tool, described in the system text (qwen format)."""
    tool = F.concat(F.lit('[{"name": "look_'), F.col("conv_id") % 5, F.lit('", "description": "Looks \\"up\\".", "parameters": {"type": "object", "properties": {}, "required": []}}]'))
    rows = canonical(spark, sf_dir).withColumn("_tools", F.when(F.col("conv_id") % 3 != 0, tool).otherwise(""))
    return sft_digests(stages.process_sft(rows, TEMPLATES["qwen"], CUTOFF, keep=["conv_id"]))


QWEN_SYSTEM = f"'<|im_start|>system' || {NL} || CASE WHEN system <> '' THEN system ELSE 'You are a helpful assistant.' END || {{more}} || '<|im_end|>' || {NL}"
_BEFORE, _AFTER = (part.replace("{{", "{").replace("}}", "}") for part in QWEN_PROMPT.split("{tools}"))
_TOOL = """chr(10) || '{"type": "function", "function": {"name": "look_' || (conv_id % 5) || '", "description": "Looks \\"up\\".", "parameters": {"type": "object", "properties": {}, "required": []}}}'"""
PRC_TOOLS = sft_digest_sql(system=QWEN_SYSTEM.format(more=f"CASE WHEN conv_id % 3 <> 0 THEN '{_BEFORE}' || {_TOOL} || '{_AFTER}' ELSE '' END"))


def prc_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second answer is a function call, given as JSON, written as the format writes it."""
    call = lambda m: F.concat(F.lit('{"name":"count","arguments":{"n":'), F.length(m["content"]), F.lit(',"of":["é"]}}'))
    changed = lambda m, i: F.when(i % 4 == 1, F.struct(F.lit("function").alias("role"), call(m).alias("content"))).otherwise(m)
    rows = canonical(spark, sf_dir).withColumn("__all", F.transform(F.concat("_prompt", "_response"), changed))
    rows = rows.withColumns({"_prompt": F.slice("__all", F.lit(1), F.size("_prompt")), "_response": F.slice("__all", F.size("_prompt") + 1, F.size("_response"))})
    return sft_digests(stages.process_sft(rows, TEMPLATES["qwen"], CUTOFF, keep=["conv_id"]))


PRC_FUNCTION = sft_digest_sql(
    system=QWEN_SYSTEM.format(more="''"),
    answered="""(CASE WHEN i % 2 = 1 THEN '<tool_call>' || chr(10) || '{"name": "count", "arguments": {"n": ' || length(m[2*i].text) || ', "of": ["é"]}}' || chr(10) || '</tool_call>' ELSE m[2*i].text END)""",
)


def tpl_compiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text format as the Jinja template that is written for it, compiled to a column, and as
    the slots that are read back from rendering that template."""
    rows = canonical(spark, sf_dir).where(valid_for("sft"))
    said = F.concat("_prompt", "_response")
    system = F.array(F.struct(F.lit("system").alias("role"), F.col("_system").alias("content")))
    messages = F.when(F.col("_system") != "", F.concat(system, said)).otherwise(said)
    texts = []
    for name in TPL_COMPILED_NAMES:
        source = jinja_template(TEMPLATES[name])
        texts.append(F.struct(F.lit(name).alias("name"), F.lit("compiled").alias("way"), F.md5(compile_template(source, "<s>", "</s>")(messages)).alias("text_md5")))
        if not TEMPLATES[name].system_in_user:
            read = template_from_source(ChatTokenizer(source, "<s>", "</s>"), name)
            made = encoded(said, read, text_target("<s>", "</s>"), F.col("_system"), F.lit(""))
            texts.append(F.struct(F.lit(name).alias("name"), F.lit("read").alias("way"), F.md5(F.array_join(made, "")).alias("text_md5")))
    return rows.select("conv_id", F.inline(F.array(*texts)))


#: Formats whose slots do not number the turns (a written Jinja template has no numbers).
TPL_COMPILED_NAMES = [n for n in TPL_SQL if n != "chatglm2"]
TPL_COMPILED = " UNION ALL ".join(
    f"SELECT conv_id, '{n}' AS name, '{way}' AS way, text_md5 FROM ({TPL_SQL[n]})" for n in TPL_COMPILED_NAMES for way in ("compiled", "read") if way == "compiled" or not TEMPLATES[n].system_in_user
)


def prc_mm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image in front of every first question, whose mark becomes as many tokens as it has."""
    rows = canonical(spark, sf_dir).withColumns({"_images": F.array(F.lit("a.png")), "_image_tokens": F.array((F.col("conv_id") % 7 + 1).cast("int"))})
    marked = F.transform("_prompt", lambda m, i: F.when(i == 0, F.struct(m["role"].alias("role"), F.concat(F.lit("<image>"), m["content"]).alias("content"))).otherwise(m))
    out = stages.process_sft(rows.withColumn("_prompt", marked), TEMPLATES["qwen2_vl"], CUTOFF, keep=["conv_id"], **NO_TOOLS)
    return sft_digests(out.where(F.size("images") == 1))


PRC_MM = sft_digest_sql(system=QWEN_SYSTEM.format(more="''"), asked="(CASE WHEN i = 1 THEN '<|vision_start|>' || repeat('<|image_pad|>', CAST(conv_id % 7 + 1 AS BIGINT)) || '<|vision_end|>' ELSE '' END || m[2*i-1].text)")


def sft_prep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: align, filter, render, tokenize and budget conversations."""
    rows = canonical(spark, sf_dir).where(valid_for("sft"))
    made = encoded(F.concat("_prompt", "_response"), CHATML, text_target(), F.col("_system"), F.lit(""))
    rows = rows.withColumns({"text_md5": F.md5(F.array_join(made, "")), "n_turns": (F.size("_prompt") + 1).cast("long")})
    out = stages.process_sft(rows, CHATML, CUTOFF, keep=["conv_id", "text_md5", "n_turns"], **NO_TOOLS)
    return sft_digests(out, "text_md5", "n_turns")


SFT_PREP = f"SELECT a.conv_id, a.text_md5, a.pairs * 2 AS n_turns, b.n_input, b.n_labels, b.n_target, b.ids_md5, b.labels_md5 FROM ({TPL_SQL['chatml']}) a JOIN ({PRC_SFT}) b USING (conv_id)"


def prc_pt_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = DatasetSpec("docs", prompt="text", query=None, response=None)
    rows = stages.process_pretrain(align(table(spark, sf_dir, "documents"), spec, keep=["doc_id"]), CUTOFF, keep=["doc_id"])
    ids = F.col("input_ids")
    return rows.select("doc_id", long(F.size(ids), "n_input"), long(F.aggregate(ids, F.lit(0).cast("long"), lambda a, x: a + x), "id_sum"))


PRC_PT_PLAIN = f"""SELECT doc_id, CAST(least(length(text) + 1, {CUTOFF}) AS BIGINT) AS n_input,
  CAST(list_sum(list_transform(string_split(substring(text, 1, {CUTOFF}), ''), lambda c: CASE WHEN c = '' THEN 0 ELSE unicode(c) END)) + CASE WHEN length(text) < {CUTOFF} THEN 1114113 ELSE 0 END AS BIGINT) AS id_sum FROM documents"""


def prc_pt_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each thousand documents, with a digest of their ids."""
    spec = DatasetSpec("docs", prompt="text", query=None, response=None)
    rows = align(table(spark, sf_dir, "documents"), spec, keep=["doc_id"])
    rows = stages.process_pretrain(rows, 2**31 - 1, keep=["doc_id"]).withColumn("batch_id", F.floor(F.col("doc_id") / 1000))
    blocks = stages.pack_pretrain(rows, 2048, "batch_id", "doc_id")
    return blocks.select("batch_id", long(F.col("block"), "block"), long(F.size("input_ids"), "tokens"), ids_md5("input_ids", "ids_md5"))


PRC_PT_PACK = f"""WITH d AS (SELECT doc_id // 1000 AS b, length(text) + 1 AS n, list_transform(string_split(text, ''), lambda c: CASE WHEN c = '' THEN NULL ELSE unicode(c) END) || [{EOS_ID}] AS x,
  sum(length(text) + 1) OVER (PARTITION BY doc_id // 1000 ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - length(text) - 1 AS p0, sum(length(text) + 1) OVER (PARTITION BY doc_id // 1000) AS n_all FROM documents WHERE text IS NOT NULL),
e AS (SELECT b, n_all, p0 + generate_subscripts(list_filter(x, lambda i: i IS NOT NULL), 1) - 1 AS pos, unnest(list_filter(x, lambda i: i IS NOT NULL)) AS id FROM d)
SELECT b AS batch_id, CAST(pos // 2048 AS BIGINT) AS block, count(*) AS tokens, md5(string_agg(id, ',' ORDER BY pos)) AS ids_md5 FROM e WHERE pos // 2048 < n_all // 2048 GROUP BY 1, 2"""


def prc_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stages.process_pairwise(ranked(spark, sf_dir), CHATML, CUTOFF, keep=["conv_id"], **NO_TOOLS)
    made = [f(c, n) for side in ("chosen", "rejected") for f, c, n in ((ids_md5, F.col(f"{side}_input_ids"), f"{side}_md5"), (ids_md5, F.col(f"{side}_labels"), f"{side}_labels_md5"))]
    return rows.select("conv_id", long(F.size("chosen_input_ids"), "n_chosen"), long(F.size("rejected_input_ids"), "n_rejected"), long(learned("chosen_labels"), "chosen_target"), long(learned("rejected_labels"), "rejected_target"), *made)


def prompt_sql(last: str) -> str:
    """The rendered messages up to ``last``."""
    return f"({SYSTEM} || array_to_string(list_transform(range(1, {last} + 1), lambda i: CASE WHEN i % 2 = 1 THEN {USER.format(text='m[i].text')} ELSE {ANSWER.format(text='m[i].text')} END), ''))"


_S, _T = seqlen_sql("length(p)", "greatest(length(c), length(r))", str(CUTOFF))
PAIRS = (
    V
    + f""", z AS (SELECT conv_id, {prompt_sql('n')} AS p, {ANSWER.format(text="'Yes. ' || m[-1].text")} AS c, {ANSWER.format(text="'No. ' || m[-1].text")} AS r FROM v WHERE ok AND n % 2 = 1),
k AS (SELECT conv_id, CAST({_S} AS BIGINT) AS s, substring(p, 1, {_S}) AS p, substring(c, 1, {_T}) AS c, substring(r, 1, {_T}) AS r FROM z)"""
)
PRC_PAIR = (
    PAIRS
    + f"""SELECT conv_id, CAST(s + length(c) AS BIGINT) AS n_chosen, CAST(s + length(r) AS BIGINT) AS n_rejected, CAST(length(c) AS BIGINT) AS chosen_target, CAST(length(r) AS BIGINT) AS rejected_target,
  {ids_md5_sql(ids_sql('(p || c)'))} AS chosen_md5, {ids_md5_sql("repeat('-100,', s) || " + ids_sql('c'))} AS chosen_labels_md5,
  {ids_md5_sql(ids_sql('(p || r)'))} AS rejected_md5, {ids_md5_sql("repeat('-100,', s) || " + ids_sql('r'))} AS rejected_labels_md5 FROM k"""
)


def prc_unsup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stages.process_unsupervised(canonical(spark, sf_dir), CHATML, CUTOFF, keep=["conv_id"], **NO_TOOLS)
    return rows.select("conv_id", long(F.size("input_ids"), "n_input"), long(F.size("labels"), "n_labels"), ids_md5("input_ids", "ids_md5"), ids_md5("labels", "labels_md5"))


_US, _UT = seqlen_sql("length(p)", "length(c)", str(CUTOFF))
PRC_UNSUP = (
    V
    + f""", z AS (SELECT conv_id, {prompt_sql('n - 1')} AS p, {ANSWER.format(text='m[-1].text')} AS c FROM v WHERE ok AND n % 2 = 0 AND n > 0),
k AS (SELECT conv_id, substring(p, 1, {_US}) AS p, substring(c, 1, {_UT}) AS c FROM z)
SELECT conv_id, CAST(length(p) AS BIGINT) AS n_input, CAST(length(c) AS BIGINT) AS n_labels, {ids_md5_sql(ids_sql('p'))} AS ids_md5, {ids_md5_sql(ids_sql('c'))} AS labels_md5 FROM k"""
)


def prc_kto(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stages.process_kto(rated(spark, sf_dir), CHATML, CUTOFF, "doc_id", keep=["doc_id"], batch_size=BATCH, **NO_TOOLS)
    made = [ids_md5(F.col(c), c.replace("input_ids", "ids") + "_md5") for c in ("input_ids", "labels", "kl_input_ids", "kl_labels")]
    return rows.select("doc_id", "kto_tags", long(F.size("input_ids"), "n_input"), long(F.size("kl_input_ids"), "n_kl_input"), *made)


_KS, _KT = seqlen_sql("length(p)", "length(a)", str(CUTOFF))
_QS, _QT = seqlen_sql("length(p)", "length(k)", str(CUTOFF))
PRC_KTO = f"""
WITH r AS (SELECT doc_id, doc_id // {BATCH} AS b, quality = 1 AS tag, {ANSWER.format(text='text')} AS a, {USER.format(text="concat_ws(chr(10), nullif(source, ''), nullif(lang, ''))")} AS p FROM documents JOIN labels USING (doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY b) AS n FROM r),
z AS (SELECT o.doc_id, o.tag, o.p, o.a, y.a AS k FROM o JOIN o y ON y.b = o.b AND y.i = o.n + 1 - o.i),
c AS (SELECT doc_id, tag, substring(p, 1, {_KS}) AS p, substring(a, 1, {_KT}) AS a, substring(p, 1, {_QS}) AS q, substring(k, 1, {_QT}) AS k FROM z)
SELECT doc_id, tag AS kto_tags, CAST(length(p) + length(a) AS BIGINT) AS n_input, CAST(length(q) + length(k) AS BIGINT) AS n_kl_input,
  {ids_md5_sql(ids_sql('(p || a)'))} AS ids_md5, {ids_md5_sql("repeat('-100,', length(p)) || " + ids_sql('a'))} AS labels_md5,
  {ids_md5_sql(ids_sql('(q || k)'))} AS kl_ids_md5, {ids_md5_sql("repeat('-100,', length(q)) || " + ids_sql('k'))} AS kl_labels_md5 FROM c"""


def prc_kto_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rated answer beside that of its mirrored batch partner."""
    rows = stages.kl_partners(rated(spark, sf_dir), "doc_id", BATCH)
    text = lambda c: F.md5(F.array_join(F.transform(c, lambda m: m["content"]), ""))
    return rows.select("doc_id", text("_response").alias("own_md5"), text("__kl").alias("partner_md5"))


PRC_KTO_KL = f"""
WITH r AS (SELECT doc_id, doc_id // {BATCH} AS b, md5(text) AS h FROM documents JOIN labels USING (doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY b) AS n FROM r)
SELECT o.doc_id, o.h AS own_md5, y.h AS partner_md5 FROM o JOIN o y ON y.b = o.b AND y.i = o.n + 1 - o.i"""


def prc_kto_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stages.process_kto(rated(spark, sf_dir), CHATML, CUTOFF, "doc_id", keep=["doc_id"], batch_size=BATCH, **NO_TOOLS)
    out = stages.preference_balance(rows.withColumn("batch_id", F.floor(F.col("doc_id") / BATCH)), "batch_id")
    return out.select("batch_id", long(F.col("liked"), "liked"), long(F.col("other"), "other"), "one_sided")


PRC_KTO_BALANCE = f"""SELECT doc_id // {BATCH} AS batch_id, count(*) FILTER (quality = 1) AS liked, count(*) FILTER (quality <> 1) AS other,
  count(*) FILTER (quality = 1) = 0 OR count(*) FILTER (quality <> 1) = 0 AS one_sided FROM documents JOIN labels USING (doc_id) GROUP BY 1"""


def src_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a dataset of a file spec, counted by language and source."""
    from loomspark.sources.readers import read_dataset

    rows = read_dataset(spark, DatasetSpec("documents.parquet"), sf_dir)
    return rows.groupBy("lang", "source").agg(long(F.count(F.lit(1)), "n"), long(F.sum("n_chars"), "chars"))


SRC_PARQUET = "SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1, 2"


def prc_infer_seqlen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("t"), F.pmod(F.col("doc_id") * 7919, F.lit(4000)).cast("int").alias("s"))
    source, target = stages.infer_seqlen(F.col("s"), F.col("t"), F.lit(2048))
    return rows.select("doc_id", long(source, "source_len"), long(target, "target_len"))


_IS, _IT = seqlen_sql("s", "t", "2048")
PRC_INFER_SEQLEN = f"WITH r AS (SELECT doc_id, CAST(length(text) AS BIGINT) AS t, CAST((doc_id * 7919) % 4000 AS BIGINT) AS s FROM documents) SELECT doc_id, CAST({_IS} AS BIGINT) AS source_len, CAST({_IT} AS BIGINT) AS target_len FROM r"


def sft_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stages.process_sft(canonical(spark, sf_dir), CHATML, CUTOFF, keep=["conv_id"], **NO_TOOLS)
    return rows.withColumn("batch_id", F.floor(F.col("conv_id") / BATCH))


def agg_valid_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.operators.metrics import valid_ratio

    out = valid_ratio(sft_rows(spark, sf_dir), "batch_id")
    return out.select(long(F.col("valid_tokens"), "valid_tokens"), long(F.col("total_tokens"), "total_tokens"), F.round("valid_ratio", 6).alias("valid_ratio"))


AGG_VALID_RATIO = f"""WITH a AS ({sft_sql()}), b AS (SELECT conv_id // {BATCH} AS b, sum(n_target) AS v, max(n_input) * count(*) AS t FROM a GROUP BY 1)
SELECT CAST(sum(v) AS BIGINT) AS valid_tokens, CAST(sum(t) AS BIGINT) AS total_tokens, round(CAST(sum(v) AS DOUBLE) / sum(t), 6) AS valid_ratio FROM b"""


def col_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = collate.pad_batches(sft_rows(spark, sf_dir), "batch_id")
    real = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    return rows.select("conv_id", long(F.size("input_ids"), "padded"), long(real, "real"), long(F.size("labels"), "n_labels"), ids_md5("input_ids", "ids_md5"), ids_md5("labels", "labels_md5"))


COL_PAD = f"""WITH a AS (SELECT *, CAST(ceil(max(n_input) OVER (PARTITION BY conv_id // {BATCH}) / 8.0) * 8 AS BIGINT) AS padded FROM ({sft_sql()}))
SELECT conv_id, padded, n_input AS real, padded AS n_labels, {ids_md5_sql(f"ids || repeat('{PAD_ID},', padded - n_input)")} AS ids_md5, {ids_md5_sql("labels || repeat('-100,', padded - n_input)")} AS labels_md5 FROM a"""


def col_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = collate.pair_batch(stages.process_pairwise(ranked(spark, sf_dir), CHATML, CUTOFF, keep=["conv_id"], **NO_TOOLS), "conv_id")
    return rows.select("conv_id", long(F.col("side"), "side"), long(F.size("input_ids"), "n_input"), ids_md5("input_ids", "ids_md5"))


COL_PAIR = f"WITH q AS ({PRC_PAIR}) SELECT conv_id, CAST(0 AS BIGINT) AS side, n_chosen AS n_input, chosen_md5 AS ids_md5 FROM q UNION ALL SELECT conv_id, CAST(1 AS BIGINT), n_rejected, rejected_md5 FROM q"


def pk_blocks(spark: SparkSession, sf_dir: str, neat: bool) -> DataFrame:
    """Rows are cut at the size of the blocks, as in data preparation, so every row is in one."""
    return collate.pack_sft(sft_rows(spark, sf_dir), CUTOFF, "batch_id", "conv_id", neat)


def pk_sft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the blocks, which any packing shares."""
    rows = pk_blocks(spark, sf_dir, False)
    return rows.groupBy("batch_id").agg(long(F.sum("segments"), "rows_packed"), long(F.sum(learned("labels")), "targets"), long(F.max(F.size("input_ids")), "block_size"), long(F.min(F.size("attention_mask")), "mask_size"))


PK_SFT = f"WITH a AS ({sft_sql()}) SELECT conv_id // {BATCH} AS batch_id, CAST(count(*) AS BIGINT) AS rows_packed, CAST(sum(n_target) AS BIGINT) AS targets, CAST({CUTOFF + 1} AS BIGINT) AS block_size, CAST({CUTOFF + 1} AS BIGINT) AS mask_size FROM a GROUP BY 1"


def pk_neat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows as they stand in the blocks, cut out by the numbers in the mask."""
    blocks = pk_blocks(spark, sf_dir, True).withColumn("sizes", collate.segment_lengths(F.col("attention_mask")))
    before = F.aggregate(F.slice("sizes", F.lit(1), F.col("at")), F.lit(0), lambda a, n: a + n)
    parts = blocks.select("*", F.posexplode("sizes").alias("at", "n")).withColumn("from", before + 1)
    ids, labels = F.slice("input_ids", F.col("from"), F.col("n")), F.slice("labels", F.col("from"), F.col("n"))
    return parts.select(F.get("rows", F.col("at")).alias("conv_id"), long(F.col("n"), "n_input"), ids_md5(ids, "ids_md5"), ids_md5(labels, "labels_md5"))


PK_NEAT = f"SELECT conv_id, n_input, {ids_md5_sql('ids')} AS ids_md5, {ids_md5_sql('labels')} AS labels_md5 FROM ({sft_sql()})"


def pk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows each block holds, in their order: the packing plan itself."""
    blocks = pk_blocks(spark, sf_dir, True)
    return blocks.select("batch_id", "block", F.posexplode("rows").alias("position", "conv_id")).select("batch_id", long(F.col("block"), "block"), long(F.col("position"), "position"), "conv_id")


#: One row a step: the largest row that fits the open block (the last of equals), else a new block.
PK_PLAN = f"""WITH RECURSIVE a AS ({sft_sql()}),
s AS (SELECT conv_id // {BATCH} AS batch_id, list({{'n': n_input, 'id': conv_id}}) AS rest FROM a WHERE n_input <= {CUTOFF} GROUP BY 1),
p AS (SELECT batch_id, rest, CAST(0 AS BIGINT) AS room, CAST(-1 AS BIGINT) AS block, CAST(0 AS BIGINT) AS position, CAST(NULL AS STRUCT(n BIGINT, id BIGINT)) AS taken FROM s
  UNION ALL SELECT batch_id, list_filter(rest, lambda x: x.id <> c.id), CASE WHEN c.n <= room THEN room ELSE {CUTOFF} END - c.n, CASE WHEN c.n <= room THEN block ELSE block + 1 END,
    CASE WHEN c.n <= room THEN position + 1 ELSE 0 END, c
  FROM (SELECT *, coalesce(list_max(list_filter(rest, lambda x: x.n <= room)), list_max(rest)) AS c FROM p WHERE len(rest) > 0))
SELECT batch_id, block, position, taken.id AS conv_id FROM p WHERE taken IS NOT NULL"""


def turn_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mask of segment numbers, one segment a turn: a place for every 16 characters."""
    rows = chats(spark, sf_dir)
    return rows.select("conv_id", F.flatten(F.transform("messages", lambda m, i: F.array_repeat(i + 1, F.ceil(F.length(m["text"]) / 16).cast("int")))).alias("attention_mask"))


def pk_seqlens(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = collate.segment_lengths(F.col("attention_mask"))
    return turn_masks(spark, sf_dir).select("conv_id", F.posexplode(lengths).alias("segment", "n")).select("conv_id", long(F.col("segment"), "segment"), long(F.col("n"), "n"))


PK_SEQLENS = "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS segment, CAST(ceil(length(text) / 16.0) AS BIGINT) AS n FROM conversations WHERE length(text) > 0"


def pk_unpad(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = collate.unpadded(turn_masks(spark, sf_dir), "conv_id")
    return out.select("conv_id", long(F.col("segment"), "segment"), long(F.col("cu_start"), "cu_start"), long(F.col("cu_end"), "cu_end"))


PK_UNPAD = f"SELECT conv_id, segment, CAST(sum(n) OVER w - n AS BIGINT) AS cu_start, CAST(sum(n) OVER w AS BIGINT) AS cu_end FROM ({PK_SEQLENS}) WINDOW w AS (ORDER BY conv_id, segment ROWS UNBOUNDED PRECEDING)"


def col_mask4d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible pairs of the block-diagonal causal mask, counted by row."""
    seen = collate.attended(F.col("attention_mask"))
    return turn_masks(spark, sf_dir).select("conv_id", long(F.aggregate(seen, F.lit(0).cast("long"), lambda a, x: a + x), "visible"))


COL_MASK4D = f"SELECT conv_id, CAST(sum(n * (n + 1) // 2) AS BIGINT) AS visible FROM ({PK_SEQLENS}) GROUP BY 1"


def src_builder_ultrachat(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = chats(spark, sf_dir).select("conv_id", F.transform("messages", lambda m: m["text"]).alias("data"))
    out = build_turn_lists(lists, keep=["conv_id"])
    return out.select("conv_id", long(F.size("conversations"), "n"), F.md5(F.array_join(F.transform("conversations", lambda m: F.concat(m["from"], F.lit(":"), m["value"])), "|")).alias("said_md5"))


SRC_BUILDER_ULTRACHAT = """WITH t AS (SELECT conv_id, list(text ORDER BY turn) AS l FROM conversations GROUP BY 1), u AS (SELECT conv_id, l[:len(l) // 2 * 2] AS l FROM t WHERE len(l) >= 2)
SELECT conv_id, CAST(len(l) AS BIGINT) AS n, md5(array_to_string(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN i % 2 = 1 THEN 'human' ELSE 'gpt' END || ':' || l[i]), '|')) AS said_md5 FROM u"""


def queries() -> dict:
    found = {
        "sft_prep": sft_prep,
        "sg_align": sg_align,
        "sg_pair": sg_pair,
        "flt_sft": flt_sft,
        "jn_role_map": jn_role_map,
        "alpaca_prompt": alpaca_prompt,
        "alpaca_kto": alpaca_kto,
        "prc_sft": prc_sft,
        "prc_sft_mask_history": prc_sft_mask_history,
        "prc_tools": prc_tools,
        "prc_function": prc_function,
        "prc_mm": prc_mm,
        "tpl_compiled": tpl_compiled,
        "prc_pt_plain": prc_pt_plain,
        "prc_pt_pack": prc_pt_pack,
        "prc_pair": prc_pair,
        "prc_unsup": prc_unsup,
        "prc_kto": prc_kto,
        "prc_infer_seqlen": prc_infer_seqlen,
        "prc_kto_kl": prc_kto_kl,
        "prc_kto_balance": prc_kto_balance,
        "src_parquet": src_parquet,
        "agg_valid_ratio": agg_valid_ratio,
        "col_pad": col_pad,
        "col_pair": col_pair,
        "pk_sft": pk_sft,
        "pk_neat": pk_neat,
        "pk_plan": pk_plan,
        "pk_seqlens": pk_seqlens,
        "pk_unpad": pk_unpad,
        "col_mask4d": col_mask4d,
        "src_builder_ultrachat": src_builder_ultrachat,
    }
    for name in TPL_SQL:
        found[f"tpl_{name}"] = lambda spark, sf_dir, name=name: rendered(spark, sf_dir, name)
    return found


def oracle_sql() -> dict[str, str]:
    found = {name: globals()[name.upper()] for name in queries() if name.upper() in globals()}
    return found | {f"tpl_{name}": sql for name, sql in TPL_SQL.items()}
