"""Queries that write, read back, stream and prepare data, with their SQL."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.lineage import remove_at_end, shared_folder
from loomspark.functions.text import EOS_ID, PAD_ID
from loomspark.operators import collate, metrics, mixing, multimodal, preference, serving, stages, tools
from loomspark.operators.align import align
from loomspark.operators.templates import TEMPLATES
from loomspark.plans.chat_queries import CHATML, NO_TOOLS, PAIRS, PRC_KTO, PRC_PAIR, PRC_SFT, ids_md5, joined_text, learned, long, turn_masks
from loomspark.plans.data_queries import L, SEED, docs, events, logps
from loomspark.plans.prepare import DataOptions, get_dataset
from loomspark.plans.tables import BATCH, CUTOFF, NL, RANKED, canonical, chats, ids_md5_sql, ids_sql, ranked, rated, sft_sql, table
from loomspark.sources import mirror, readers, sinks
from loomspark.sources.catalog import DatasetSpec, catalog_table
from loomspark.streaming import streams


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, which goes when Python ends."""
    return remove_at_end(spark, f"{shared_folder(spark)}/query-{uuid4().hex}")


# Formats of files, read back by their specs.
def stored(spark: SparkSession, rows: DataFrame, kind: str) -> DataFrame:
    path = scratch(spark)
    writer = rows.write.option("header", True).option("escape", '"').option("ignoreNullFields", True)
    writer.format(kind).save(f"{path}/part")
    return readers.read_dataset(spark, DatasetSpec("part"), path)


def src_json(spark, sf_dir):
    return stored(spark, docs(spark, sf_dir).select("doc_id", "text", "lang"), "json").select("doc_id", "lang", F.md5("text").alias("text_md5"))


SRC_JSON = "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents"


def src_csv(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", F.concat(F.lit('say "'), "source", F.lit('", '), "lang").alias("said"), "n_chars")
    return stored(spark, rows, "csv").select(F.col("doc_id").cast("long").alias("doc_id"), "said", F.col("n_chars").cast("long").alias("n_chars"))


SRC_CSV = """SELECT doc_id, 'say "' || source || '", ' || lang AS said, n_chars FROM documents"""


def src_text(spark, sf_dir):
    path = scratch(spark)
    docs(spark, sf_dir).select("source").write.text(f"{path}/part")
    found = [f for f in readers.list_files(spark, f"{path}/part") if f.endswith(".txt")]
    return spark.read.text(found).groupBy(F.col("value").alias("text")).agg(long(F.count(F.lit(1)), "n"))


SRC_TEXT = "SELECT source AS text, count(*) AS n FROM documents GROUP BY 1"


def src_catalog(spark, sf_dir):
    """A registry with an entry for each source of documents, of formats and places that its
    number decides, and how many documents it stands for."""
    sources = sorted(r[0] or "" for r in docs(spark, sf_dir).select("source").distinct().collect())
    registry = {}
    for i, name in enumerate(sources):
        places = (("file_name", f"{name}.json", True), ("script_url", name, i % 3 > 0), ("ms_hub_url", f"y/{name}", i % 5 == 2), ("hf_hub_url", f"x/{name}", i % 5 > 2))
        registry[name] = {k: v for k, v, given in places if given} | ({"formatting": "sharegpt"} if i % 2 else {}) | ({"ranking": True} if i % 4 == 1 else {})
    counts = docs(spark, sf_dir).groupBy(F.coalesce("source", F.lit("")).alias("dataset")).agg(F.count(F.lit(1)).alias("n"))
    return catalog_table(spark, registry).join(counts, "dataset")


SRC_CATALOG = """WITH s AS (SELECT coalesce(source, '') AS dataset, count(*) AS n FROM documents GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY dataset) - 1 AS i FROM s)
SELECT dataset, CASE WHEN i % 2 = 1 THEN 'sharegpt' ELSE 'alpaca' END AS formatting, i % 4 = 1 AS ranking,
  CASE WHEN i % 5 > 2 THEN 'huggingface' WHEN i % 5 = 2 THEN 'modelscope' WHEN i % 3 > 0 THEN 'script' ELSE 'file' END AS load_from,
  CASE WHEN i % 5 > 2 THEN 'x/' || dataset WHEN i % 5 = 2 THEN 'y/' || dataset WHEN i % 3 > 0 THEN dataset ELSE dataset || '.json' END AS location, n FROM i"""


def src_hub(spark, sf_dir):
    """Documents written as a mirror of a repository, a folder a language and a file name a split, and
    read back by subset and split, from another folder, and as a stream."""
    path, langs = scratch(spark), ("de", "en")
    rows = docs(spark, sf_dir).where(F.col("lang").isin(*langs)).select("doc_id", "lang", "text", F.when(F.col("doc_id") % 4 == 0, "test").otherwise("train").alias("split"))
    rows.write.partitionBy("lang", "split").json(f"{path}/hub/team/texts/data")
    mirror.register_mirror("modelscope", f"{path}/hub")
    out = []
    for lang, split in (("lang=de", "train"), ("lang=en", "test"), ("lang=en", "train+test")):
        spec = DatasetSpec("team/texts", "modelscope", folder="data", subset=lang, split=split)
        out.append(readers.read_dataset(spark, spec).select("doc_id", F.md5("text").alias("text_md5"), F.lit(f"{lang} {split}").alias("part")))
    spec = DatasetSpec("team/texts", "modelscope", folder="data", subset="lang=de", split="test")
    stream = readers.stream_dataset(spark, spec).select("doc_id", F.md5("text").alias("text_md5"), F.lit("stream").alias("part"))
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return reduce(DataFrame.unionByName, [*out, spark.read.schema(stream.schema).parquet(f"{path}/out")])


SRC_HUB = """SELECT doc_id, md5(text) AS text_md5, 'lang=de train' AS part FROM documents WHERE lang = 'de' AND doc_id % 4 <> 0
UNION ALL SELECT doc_id, md5(text), 'lang=en test' FROM documents WHERE lang = 'en' AND doc_id % 4 = 0
UNION ALL SELECT doc_id, md5(text), 'lang=en train+test' FROM documents WHERE lang = 'en'
UNION ALL SELECT doc_id, md5(text), 'stream' FROM documents WHERE lang = 'de' AND doc_id % 4 = 0"""


def src_preview(spark, sf_dir):
    n, rows = readers.preview(docs(spark, sf_dir).select("doc_id", "source"), "doc_id", 3, 5)
    return rows.withColumn("of", F.lit(n).cast("long"))


SRC_PREVIEW = "SELECT doc_id, source, (SELECT count(*) FROM documents) AS of FROM documents ORDER BY doc_id LIMIT 5 OFFSET 15"


def snk_tokenized(spark, sf_dir):
    """Splits written as a tokenized folder, and read back by their names."""
    path = scratch(spark)
    rows = stages.process_pretrain(align(docs(spark, sf_dir), DatasetSpec("docs", prompt="text", query=None, response=None), keep=["doc_id"]), CUTOFF, keep=["doc_id"])
    sinks.write_tokenized(mixing.split(rows, 0.2, "doc_id", SEED), path)
    if not readers.has_tokenized(spark, path):
        raise RuntimeError("The tokenized folder is not seen.")
    parts = readers.read_tokenized(spark, path)
    made = [df.select("doc_id", F.lit(name).alias("part"), long(F.size("input_ids"), "n_input"), ids_md5("input_ids", "ids_md5")) for name, df in parts.items()]
    return made[0].unionByName(made[1])


SNK_TOKENIZED = f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= ceil(0.2 * (SELECT count(*) FROM documents)) THEN 'validation' ELSE 'train' END AS part,
  CAST(least(length(text) + 1, {CUTOFF}) AS BIGINT) AS n_input, {ids_md5_sql(ids_sql(f'substring(text, 1, {CUTOFF})') + f" || CASE WHEN length(text) < {CUTOFF} THEN '{EOS_ID},' ELSE '' END")} AS ids_md5 FROM documents"""


def snk_predictions_sft(spark, sf_dir):
    path = scratch(spark)
    rows = docs(spark, sf_dir).select(F.col("source").alias("prompt"), F.col("lang").alias("predict"), F.col("text").alias("label"))
    sinks.write_predictions(rows, path)
    return spark.read.json(path).groupBy("prompt", "predict").agg(long(F.count(F.lit(1)), "n"), long(F.sum(F.length("label")), "chars"))


SNK_PREDICTIONS_SFT = "SELECT source AS prompt, lang AS predict, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1, 2"


def snk_ppl(spark, sf_dir):
    path = scratch(spark)
    sinks.write_perplexities(events(spark, sf_dir).select(metrics.loss_perplexity(F.col("value") / 1000).alias("perplexity")), path)
    return spark.read.json(path).agg(long(F.count(F.lit(1)), "n"), F.round(F.sum(F.log("perplexity")), 3).alias("losses"))


SNK_PPL = "SELECT count(*) AS n, round(sum(value / 1000), 3) AS losses FROM events"


def src_trainer_log(spark, sf_dir):
    """Events as log records: written by appending twice, read back with the log's columns."""
    path = scratch(spark)
    log = events(spark, sf_dir).select(F.col("event_id").cast("int").alias("current_steps"), F.lit(10).alias("total_steps"), F.when(F.col("event_id") % 3 != 0, F.round("value", 4)).alias("loss"))
    sinks.append_log(log.where("current_steps % 2 = 0"), path)
    sinks.append_log(log.where("current_steps % 2 = 1"), path)
    return readers.with_loss(readers.read_trainer_log(spark, path)).select(long(F.col("current_steps"), "step"), "loss")


SRC_TRAINER_LOG = "SELECT CAST(event_id AS BIGINT) AS step, round(value, 4) AS loss FROM events WHERE event_id % 3 <> 0 AND round(value, 4) <> 0"


# Alignment.
def prj_alp_history(spark, sf_dir):
    rows = docs(spark, sf_dir).withColumn("history", F.array(F.array("source", "lang"), F.array(F.lit("again"), "source")))
    spec = DatasetSpec("docs", prompt="text", query=None, response="lang", history="history", system="source")
    out = align(rows, spec, keep=["doc_id"])
    return out.select("doc_id", long(F.size("_prompt"), "n_prompt"), F.md5(joined_text("_prompt")).alias("prompt_md5"), F.md5(joined_text("_response")).alias("response_md5"), "_system")


PRJ_ALP_HISTORY = """SELECT doc_id, CAST(5 AS BIGINT) AS n_prompt, md5('user:' || source || '|assistant:' || lang || '|user:again|assistant:' || source || '|user:' || text) AS prompt_md5,
  md5('assistant:' || lang) AS response_md5, source AS _system FROM documents"""


def prj_alp_pair(spark, sf_dir):
    spec = DatasetSpec("docs", ranking=True, prompt="source", query="lang", response=None, chosen="text", rejected="worse")
    rows = docs(spark, sf_dir).withColumn("worse", F.when(F.col("doc_id") % 4 != 0, F.concat("lang", "source")))
    out = align(rows, spec, keep=["doc_id"])
    return out.select("doc_id", long(F.size("_response"), "n_response"), F.md5(joined_text("_response")).alias("response_md5"))


PRJ_ALP_PAIR = """SELECT doc_id, CAST(CASE WHEN doc_id % 4 <> 0 THEN 2 ELSE 0 END AS BIGINT) AS n_response,
  md5(CASE WHEN doc_id % 4 <> 0 THEN 'assistant:' || text || '|assistant:' || lang || source ELSE '' END) AS response_md5 FROM documents"""


def prj_sg_kto(spark, sf_dir):
    """Conversations rated by the parity of their number; the other answer is empty."""
    spec = DatasetSpec(**{**RANKED.__dict__, "ranking": False, "chosen": None, "rejected": None, "kto_tag": "liked"})
    rows = align(chats(spark, sf_dir).withColumn("liked", F.col("conv_id") % 2 == 0), spec, keep=["conv_id"])
    return rows.where(F.size("_prompt") > 0).select("conv_id", F.md5(joined_text("_response")).alias("response_md5"))


PRJ_SG_KTO = (
    sft_sql().split(", s AS (")[0].replace("WITH RECURSIVE", "WITH")
    + """SELECT conv_id, md5(CASE WHEN conv_id % 2 = 0 THEN 'assistant:' || m[-1].text || '|assistant:' ELSE 'assistant:|assistant:' || m[-1].text END) AS response_md5 FROM v WHERE ok AND n % 2 = 0 AND n > 0"""
)


def prc_dispatch(spark, sf_dir):
    """Data preparation from the dataset's name on: registry, files, alignment and stage."""
    path = scratch(spark)
    chats(spark, sf_dir).select("messages").write.json(f"{path}/chats")
    tags = {"role_tag": "role", "content_tag": "text", "user_tag": "user", "assistant_tag": "assistant", "observation_tag": "observation", "function_tag": "function", "system_tag": "system"}
    registry = {"chats": {"file_name": "chats", "formatting": "sharegpt", "columns": {"messages": "messages"}, "tags": tags}}
    out = get_dataset(spark, DataOptions(template="chatml", dataset=("chats",), dataset_dir=path, cutoff_len=CUTOFF, tools_date=None), "sft", registry)["train"]
    return out.groupBy(ids_md5("input_ids", "ids_md5"), ids_md5("labels", "labels_md5")).agg(long(F.count(F.lit(1)), "n"))


PRC_DISPATCH = f"SELECT ids_md5, labels_md5, count(*) AS n FROM ({PRC_SFT}) GROUP BY 1, 2"


# Tools.
def tool_descriptions(spark, sf_dir):
    """A tool's description in each of the five formats."""
    tool = F.concat(F.lit('[{"name": "t'), "item_id", F.lit('", "description": "Finds é", "parameters": {"type": "object", "properties": {"q": {"type": "string", "description": "what", "enum": ["a", "b"]}}, "required": ["q"]}}]'))
    rows = table(spark, sf_dir, "benchmark").select("item_id", tool.alias("tool"))
    return rows.select("item_id", *(F.md5(tools.tools_text(F.col("tool"), name)).alias(f"{name}_md5") for name in ("default", "glm4", "llama3", "mistral", "qwen")))


_LINE = """'{"name": "t' || item_id || '", "description": "Finds é", "parameters": {"type": "object", "properties": {"q": {"type": "string", "description": "what", "enum": ["a", "b"]}}, "required": ["q"]}}'"""
_WRAPPED = f"""'{{"type": "function", "function": ' || {_LINE} || '}}'"""


def _indented(pad: str) -> str:
    lines = ['{', '    "name": "t@",', '    "description": "Finds é",', '    "parameters": {', '        "type": "object",', '        "properties": {', '            "q": {', '                "type": "string",', '                "description": "what",']
    lines += ['                "enum": [', '                    "a",', '                    "b"', '                ]', '            }', '        },', '        "required": [', '            "q"', '        ]', '    }', '}']
    return f"\n{pad}".join(lines)


def _text_sql(text: str) -> str:
    return "replace('" + text.replace("'", "''") + "', '@', CAST(item_id AS VARCHAR))"


_DEFAULT = tools.REACT_PROMPT.replace("{{", "{").replace("}}", "}").replace("{tools}", "> Tool Name: t@\nTool Description: Finds é\nTool Args:\n  - q (string, required): what, should be one of [a, b]\n\n").replace("{names}", "t@")
_GLM4 = tools.GLM4_PROMPT.replace("{tools}", "\n\n## t@\n\n" + _indented("") + "\n在调用上述函数时，请使用 Json 格式表示调用的参数。")
_LLAMA3 = tools.LLAMA3_PROMPT.replace("{{", "{").replace("}}", "}").replace("{date}", "01 Jan 2025").replace("{tools}", '{\n    "type": "function",\n    "function": ' + _indented("    ") + "\n}\n\n")
_QWEN = [part.replace("{{", "{").replace("}}", "}") for part in tools.QWEN_PROMPT.split("{tools}")]
TOOL_DESCRIPTIONS = f"""SELECT item_id, md5({_text_sql(_DEFAULT)}) AS default_md5, md5({_text_sql(_GLM4)}) AS glm4_md5, md5({_text_sql(_LLAMA3)}) AS llama3_md5,
  md5('[AVAILABLE_TOOLS] [' || {_WRAPPED} || '][/AVAILABLE_TOOLS]') AS mistral_md5, md5('{_QWEN[0]}' || chr(10) || {_WRAPPED} || '{_QWEN[1]}') AS qwen_md5 FROM benchmark"""


def flt_tool_schema(spark, sf_dir):
    given = F.when(F.col("doc_id") % 3 == 0, '[{"name": "x"}, {"name": "y"}]').when(F.col("doc_id") % 3 == 1, '[{"nom": "x"}]').otherwise('{"name": "x"}')
    return docs(spark, sf_dir).select("doc_id", serving.valid_tools(given).alias("valid"))


FLT_TOOL_SCHEMA = "SELECT doc_id, doc_id % 3 = 0 AS valid FROM documents"


# Stages and collation.
def prc_sft_eos(spark, sf_dir):
    """A format whose answers end with one end token a row, learned in front of each question."""
    out = stages.process_sft(canonical(spark, sf_dir), TEMPLATES["solar"], CUTOFF, keep=["conv_id"], **NO_TOOLS)
    return out.select("conv_id", long(F.size("input_ids"), "n_input"), long(learned("labels"), "n_target"), ids_md5("input_ids", "ids_md5"), ids_md5("labels", "labels_md5"))


_EOS = (
    sft_sql(system=f"CASE WHEN system <> '' THEN '### System:' || {NL} || system || {NL} || {NL} ELSE '' END")
    .replace(f"'<|im_start|>user' || {NL} || m[2*i-1].text || '<|im_end|>' || {NL} || '<|im_start|>assistant' || {NL}", f"'### User:' || {NL} || m[2*i-1].text || {NL} || {NL} || '### Assistant:' || {NL}")
    .replace(f"m[2*i].text || '<|im_end|>' || {NL}", "m[2*i].text")
    .replace("CAST(0 AS BIGINT) AS total", "CAST(1 AS BIGINT) AS total")
    .replace("string_agg(repeat('-100,', f.s) ||", f"string_agg(CASE WHEN f.s > 0 THEN '{EOS_ID},' || repeat('-100,', f.s - 1) ELSE '' END ||")
    .replace("CAST(sum(f.t) AS BIGINT) AS n_target", "CAST(sum(f.t + CASE WHEN f.s > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_target")
)
PRC_SFT_EOS = f"SELECT conv_id, n_input + 1 AS n_input, n_target + 1 AS n_target, {ids_md5_sql(f'''ids || '{EOS_ID},' ''')} AS ids_md5, {ids_md5_sql(f'''labels || '{EOS_ID},' ''')} AS labels_md5 FROM ({_EOS})"


def flt_pack_len(spark, sf_dir):
    rows = stages.process_pretrain(align(docs(spark, sf_dir), DatasetSpec("docs", prompt="text", query=None, response=None), keep=["doc_id"]), 2**31 - 1, keep=["doc_id"])
    out = collate.too_long(rows.withColumn("batch_id", F.floor(F.col("doc_id") / 1000)), CUTOFF, "batch_id")
    return out.select("batch_id", long(F.col("dropped"), "dropped"), long(F.col("longest"), "longest"))


FLT_PACK_LEN = f"SELECT doc_id // 1000 AS batch_id, count(*) FILTER (length(text) + 1 > {CUTOFF}) AS dropped, CAST(max(length(text) + 1) FILTER (length(text) + 1 > {CUTOFF}) AS BIGINT) AS longest FROM documents GROUP BY 1"


def col_kto(spark, sf_dir):
    rows = stages.process_kto(rated(spark, sf_dir), CHATML, CUTOFF, "doc_id", keep=["doc_id"], batch_size=BATCH, **NO_TOOLS)
    out = collate.kto_batch(rows.withColumn("batch_id", F.floor(F.col("doc_id") / BATCH)), "batch_id", "doc_id")
    return out.select("doc_id", long(F.col("target_length"), "target_length"), long(F.col("kl_length"), "kl_length"), ids_md5("input_ids", "ids_md5"), ids_md5("kl_labels", "kl_labels_md5"))


_LENGTH = f"CAST(ceil(max({{n}}) OVER (PARTITION BY doc_id // {BATCH}) / 8.0) * 8 AS BIGINT)"
COL_KTO = (
    PRC_KTO.split("SELECT doc_id, tag AS kto_tags")[0]
    + f""", k AS (SELECT doc_id, p || a AS ids, length(q) AS s, k AS t, length(p || a) AS n, length(q) + length(k) AS kn FROM c),
w AS (SELECT *, {_LENGTH.format(n='n')} AS target_length, {_LENGTH.format(n='kn')} AS kl_length FROM k)
SELECT doc_id, target_length, kl_length, {ids_md5_sql(ids_sql('ids') + f" || repeat('{PAD_ID},', target_length - n)")} AS ids_md5,
  {ids_md5_sql("repeat('-100,', s) || " + ids_sql('t') + " || repeat('-100,', kl_length - kn)")} AS kl_labels_md5 FROM w"""
)


def col_ppl_pair(spark, sf_dir):
    rows = stages.process_pairwise(ranked(spark, sf_dir), CHATML, CUTOFF, keep=["conv_id"], **NO_TOOLS)
    some, all_ = collate.chosen_only(rows, False), collate.chosen_only(rows, True).select("conv_id", ids_md5("labels", "all_labels_md5"))
    return some.select("conv_id", ids_md5("input_ids", "ids_md5"), ids_md5("labels", "labels_md5")).join(all_, "conv_id")


COL_PPL_PAIR = f"SELECT conv_id, chosen_md5 AS ids_md5, chosen_labels_md5 AS labels_md5, chosen_md5 AS all_labels_md5 FROM ({PRC_PAIR})"


def col_4d_switch(spark, sf_dir):
    """Visible places of the matrix, and the mask as it is where attention takes none."""
    rows = turn_masks(spark, sf_dir).where(F.size("attention_mask") <= 400)
    zeros = F.aggregate(collate.attention_mask(F.col("attention_mask"), True), F.lit(0), lambda a, row: a + F.size(F.filter(row, lambda x: x == 0)))
    plain = F.aggregate(collate.attention_mask(F.col("attention_mask"), True, "flash_attention_2"), F.lit(0.0), lambda a, x: a + x)
    return rows.select("conv_id", long(zeros, "visible"), plain.alias("plain"))


COL_4D_SWITCH = """WITH n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, CAST(ceil(length(text) / 16.0) AS BIGINT) AS n FROM conversations)
SELECT conv_id, CAST(sum(n * (n + 1) // 2) AS BIGINT) AS visible, CAST(sum(i * n) AS DOUBLE) AS plain FROM n GROUP BY 1 HAVING sum(n) <= 400"""


# Media, metrics, preferences, serving.
def mm_prepend(spark, sf_dir):
    rows = canonical(spark, sf_dir).where(F.size("_prompt") > 0)
    media = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("a"), F.lit("b")))
    return rows.select("conv_id", F.md5(joined_text(multimodal.prepended(F.col("_prompt"), media, multimodal.IMAGE))).alias("prompt_md5"))


MM_PREPEND = (
    PAIRS.split(", z AS (")[0]
    + """SELECT conv_id, md5(array_to_string(list_transform(range(1, n), lambda i: m[i].role || ':' || CASE WHEN i = 1 AND conv_id % 2 = 0 THEN '<image><image>' ELSE '' END || m[i].text), '|')) AS prompt_md5 FROM v WHERE ok AND n % 2 = 0 AND n > 0"""
)


def agg_score_dump(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.when(F.col("event_id") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("a"), (F.col("value") * 2).alias("b"))
    return metrics.mean_scores(rows, ["a", "b"], skip_nan=True).select(F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


AGG_SCORE_DUMP = "SELECT round(avg(value) FILTER (event_id % 9 <> 0), 4) AS a, round(avg(value * 2), 4) AS b FROM events"


def agg_ppl_loss(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.round(metrics.loss_perplexity(F.col("value") / 1000), 6).alias("perplexity"))


AGG_PPL_LOSS = "SELECT event_id, round(exp(value / 1000), 6) AS perplexity FROM events"


def agg_ppo_counts(spark, sf_dir):
    made = metrics.step_counts(2, 4, 3, 2, 2.5, docs(spark, sf_dir).count())
    return spark.createDataFrame([tuple(made.values())], ", ".join(f"{k} long" for k in made))


AGG_PPO_COUNTS = "SELECT CAST(8 AS BIGINT) AS backward_batch, CAST(48 AS BIGINT) AS total_batch, CAST(ceil(count(*) / 48.0) AS BIGINT) AS steps_per_epoch, CAST(ceil(2.5 * ceil(count(*) / 48.0)) AS BIGINT) AS total_steps FROM documents"


def ls_ref_gate(spark, sf_dir):
    """Preference pairs by the stage and loss that their label decides: a stage that needs no
    reference gives its pairs without the reference's part."""
    out = []
    for i, (stage, loss) in enumerate(REF_GATES):
        rows = logps(spark, sf_dir).where(F.col("label") % len(REF_GATES) == i)
        needed = preference.uses_reference(stage, loss)
        margin = F.col("chosen") - F.col("rejected") - ((F.col("ref_chosen") - F.col("ref_rejected")) if needed else F.lit(0.0))
        out.append(rows.select("vec_id", F.lit(stage).alias("stage"), F.lit(loss).alias("loss"), F.lit(needed).alias("reference"), F.round(margin, 6).alias("margin")))
    return reduce(DataFrame.unionByName, out)


REF_GATES = [(s, k) for s in ("dpo", "kto") for k in ("sigmoid", "orpo", "simpo")]
LS_REF_GATE = f"""WITH s AS (SELECT unnest([{', '.join(f"{{'i': {i}, 'stage': '{s}', 'loss': '{k}'}}" for i, (s, k) in enumerate(REF_GATES))}]) AS g)
SELECT vec_id, g.stage AS stage, g.loss AS loss, g.stage = 'dpo' AND g.loss = 'sigmoid' AS reference, round(c - r - CASE WHEN g.stage = 'dpo' AND g.loss = 'sigmoid' THEN rc - rr ELSE 0 END, 6) AS margin
FROM {L} x JOIN s ON x.label % {len(REF_GATES)} = g.i"""


def api_scores(spark, sf_dir):
    out = serving.scored(docs(spark, sf_dir).select("doc_id", "text"), "text", lambda texts: [len(t) / 2 for t in texts])
    return out.select("doc_id", "score")


API_SCORES = "SELECT doc_id, length(text) / 2 AS score FROM documents"


# Mixes and splits of one dataset, and streams.
def mix_single(spark, sf_dir):
    rows = mixing.number_rows(docs(spark, sf_dir).select("doc_id"), [F.col("doc_id").desc()])
    return mixing.mix([rows], "interleave_over").select("doc_id", "mix_pos", long(F.col("ds_idx"), "ds_idx"))


MIX_SINGLE = "SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) - 1 AS mix_pos, CAST(0 AS BIGINT) AS ds_idx FROM documents"


def spl_none(spark, sf_dir):
    parts = mixing.split(docs(spark, sf_dir).select("doc_id"), 0.0, "doc_id")
    return parts["train"].withColumn("parts", F.lit(len(parts)).cast("long"))


SPL_NONE = "SELECT doc_id, CAST(1 AS BIGINT) AS parts FROM documents"


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")


def st_take(spark, sf_dir):
    """The table is one file, so one micro-batch: its first rows in hash order are taken."""
    path = scratch(spark)
    streams.take_and_skip(streamed(spark, sf_dir, "documents").select("doc_id"), "doc_id", 25, path, f"{path}/checkpoint", SEED).awaitTermination()
    parts = [spark.read.parquet(f"{path}/{part}").select("doc_id", F.lit(part).alias("part")) for part in ("train", "validation")]
    return parts[0].unionByName(parts[1])


ST_TAKE = "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= 25 THEN 'validation' ELSE 'train' END AS part FROM documents"


def in_batches(spark, sf_dir, name: str, path: str, cuts: tuple[str, ...]) -> DataFrame:
    """The ids of a table as a stream of micro-batches, one for each condition: each is one file,
    and the files are written one after the other."""
    ids = table(spark, sf_dir, name).select("doc_id")
    for cut in cuts:
        ids.where(cut).coalesce(1).write.mode("append").parquet(f"{path}/{name}")
    return spark.readStream.schema(ids.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/{name}")


BUFFER = 60


def st_shuffle(spark, sf_dir):
    """Three micro-batches shuffled through one buffer, which is emptied in the end."""
    path = scratch(spark)
    stream = in_batches(spark, sf_dir, "documents", path, ("doc_id % 4 < 2", "doc_id % 4 = 2", "doc_id % 4 = 3"))
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")
    streams.shuffled_batches(stream, "doc_id", write, f"{path}/checkpoint", SEED, BUFFER).awaitTermination()
    streams.shuffled_rest(spark, "doc_id", write, f"{path}/checkpoint", SEED)
    return spark.read.parquet(f"{path}/out").select("doc_id", long(F.col("batch"), "batch"), "place")


ST_SHUFFLE = f"""WITH d AS (SELECT doc_id, greatest(doc_id % 4, 1) - 1 AS b FROM documents),
a AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:0:' || doc_id), doc_id) - 1 AS place, count(*) OVER () - {BUFFER} AS cut FROM d WHERE b = 0),
p AS (SELECT doc_id FROM a WHERE place >= cut UNION ALL SELECT doc_id FROM d WHERE b = 1),
c AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:1:' || doc_id), doc_id) - 1 AS place, count(*) OVER () - {BUFFER} AS cut FROM p),
q AS (SELECT doc_id FROM c WHERE place >= cut UNION ALL SELECT doc_id FROM d WHERE b = 2),
e AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:2:' || doc_id), doc_id) - 1 AS place, count(*) OVER () - {BUFFER} AS cut FROM q),
r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:3:' || doc_id), doc_id) - 1 AS place FROM e WHERE place >= cut)
SELECT doc_id, CAST(0 AS BIGINT) AS batch, place FROM a WHERE place < cut UNION ALL SELECT doc_id, 1, place FROM c WHERE place < cut
UNION ALL SELECT doc_id, 2, place FROM e WHERE place < cut UNION ALL SELECT doc_id, 3, place FROM r"""


def st_concat(spark, sf_dir):
    path = scratch(spark)
    both = streams.mix_streams([streamed(spark, sf_dir, "documents").select("doc_id"), streamed(spark, sf_dir, "labels").select("doc_id")])
    counts = both.groupBy("ds_idx").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))
    streams.keep_latest(counts, f"{path}/table", f"{path}/checkpoint", seconds=None).awaitTermination()
    return spark.read.parquet(f"{path}/table").select(long(F.col("ds_idx"), "ds_idx"), long(F.col("n"), "n"), long(F.col("ids"), "ids"))


ST_CONCAT = "SELECT CAST(0 AS BIGINT) AS ds_idx, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents UNION ALL SELECT 1, count(*), CAST(sum(doc_id) AS BIGINT) FROM labels"


def st_interleave(spark, sf_dir):
    """Two streams whose micro-batches have other sizes, mixed in turn and by chance."""
    path = scratch(spark)
    # All files are there before the query starts, and a micro-batch takes one of each stream.
    parts = [in_batches(spark, sf_dir, "documents", path, ("doc_id % 5 = 0", "doc_id % 5 in (1, 2, 3)", "doc_id % 5 = 4")), in_batches(spark, sf_dir, "labels", path, ("doc_id % 3 > 0", "doc_id % 3 = 0"))]
    out = []
    for name, settings in (("turn", ("interleave_under", None)), ("chance", ("interleave_over", [0.7, 0.3]))):
        write = lambda batch, number, name=name: batch.write.mode("overwrite").parquet(f"{path}/out-{name}/batch={number}")
        streams.interleaved_batches(parts, "doc_id", write, f"{path}/{name}", *settings, SEED).awaitTermination()
        streams.interleaved_rest(spark, 2, "doc_id", write, f"{path}/{name}", *settings, SEED)
        out.append(spark.read.parquet(f"{path}/out-{name}").select(F.lit(name).alias("kind"), "doc_id", long(F.col("ds_idx"), "ds_idx"), "mix_pos"))
    return out[0].unionByName(out[1])


ST_INTERLEAVE = """WITH d AS (SELECT doc_id, 0 AS i, row_number() OVER (ORDER BY CASE WHEN doc_id % 5 = 0 THEN 0 WHEN doc_id % 5 < 4 THEN 1 ELSE 2 END, doc_id) - 1 AS rid, count(*) OVER () AS n FROM documents
  UNION ALL SELECT doc_id, 1, row_number() OVER (ORDER BY CASE WHEN doc_id % 3 > 0 THEN 0 ELSE 1 END, doc_id) - 1, count(*) OVER () FROM labels),
u AS (SELECT k, CASE WHEN CAST('0x' || substr(md5('42:mix:' || k), 1, 8) AS BIGINT) / 4294967296.0 < 0.7 THEN 0 ELSE 1 END AS i FROM (SELECT unnest(range(8 * (SELECT count(*) FROM d) + 1000)) AS k)),
q AS (SELECT k, i, row_number() OVER (PARTITION BY i ORDER BY k) - 1 AS pick FROM u),
e AS (SELECT max(k) AS stop FROM q JOIN (SELECT i, max(n) AS n FROM d GROUP BY i) z USING (i) WHERE pick + 1 = n)
SELECT 'turn' AS kind, doc_id, CAST(i AS BIGINT) AS ds_idx, CAST(rid * 2 + i AS BIGINT) AS mix_pos FROM d WHERE rid < (SELECT min(n) FROM d)
UNION ALL SELECT 'chance', doc_id, CAST(d.i AS BIGINT), CAST(k AS BIGINT) FROM q JOIN d ON d.i = q.i AND d.rid = q.pick % d.n WHERE k <= (SELECT stop FROM e)"""


QUERIES = (
    "src_json src_csv src_text src_catalog src_hub src_preview snk_tokenized snk_predictions_sft snk_ppl src_trainer_log prj_alp_history prj_alp_pair prj_sg_kto prc_dispatch "
    "tool_descriptions flt_tool_schema prc_sft_eos flt_pack_len col_kto col_ppl_pair col_4d_switch mm_prepend agg_score_dump agg_ppl_loss agg_ppo_counts ls_ref_gate "
    "api_scores mix_single spl_none st_take st_shuffle st_concat st_interleave"
).split()


def queries() -> dict:
    return {name: globals()[name] for name in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
