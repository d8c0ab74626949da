"""Queries of sampling, mixing, splits, statistics, losses, media, evaluation and serving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions.text import IGNORE
from loomspark.operators import evaluation, metrics, mixing, multimodal, preference, segmentation, serving, tools
from loomspark.plans.chat_queries import long
from loomspark.plans.tables import canonical, chats, table
from loomspark.sources import builders, readers, sinks

SEED = 42


def r6(x: Column, name: str) -> Column:
    return F.round(x.cast("double"), 6).alias(name)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# Sampling, order, pages.
def smp_num_samples(spark, sf_dir):
    return mixing.sample_rows(docs(spark, sf_dir).select("doc_id", "lang"), 100, "doc_id", SEED).select("doc_id", "lang")


SMP_NUM_SAMPLES = "SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100"


def smp_num_samples_over(spark, sf_dir):
    labels = table(spark, sf_dir, "benchmark").select("item_id")
    return mixing.sample_rows(labels, 300, "item_id", SEED).select("item_id", long(F.col("draw"), "draw"))


SMP_NUM_SAMPLES_OVER = """WITH b AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS rid, count(*) OVER () AS n FROM benchmark)
SELECT item_id, CAST(0 AS BIGINT) AS draw FROM b UNION ALL
SELECT b.item_id, d.k AS draw FROM (SELECT unnest(range(1, 301 - (SELECT count(*) FROM benchmark))) AS k) d
JOIN b ON b.rid = CAST('0x' || substr(md5('42:again:' || d.k), 1, 8) AS BIGINT) % b.n"""


def smp_max_samples(spark, sf_dir):
    return mixing.first_rows(docs(spark, sf_dir).select("doc_id", "source"), 50, "doc_id")


SMP_MAX_SAMPLES = "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 50"


def smp_page(spark, sf_dir):
    return mixing.page(docs(spark, sf_dir).select("doc_id", "lang"), 7, "doc_id")


SMP_PAGE = "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 2 OFFSET 14"


def smp_train_order(spark, sf_dir):
    return mixing.training_order(docs(spark, sf_dir).select("doc_id"), "doc_id", SEED, epoch=1).select("doc_id", "rank")


SMP_TRAIN_ORDER = "SELECT doc_id, row_number() OVER (ORDER BY md5('42:1:' || doc_id), doc_id) - 1 AS rank FROM documents"


def smp_fewshot(spark, sf_dir):
    d = docs(spark, sf_dir)
    out = mixing.few_shot(d.select("lang", F.col("doc_id").alias("item")), d.select("lang", F.col("doc_id").alias("support")), "lang", "item", "support", 5, SEED)
    return out.select("lang", "item", "support", long(F.col("shot_rank"), "shot_rank"))


SMP_FEWSHOT = """WITH s AS (SELECT lang, doc_id AS support, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) - 1 AS at, count(*) OVER (PARTITION BY lang) AS n FROM documents),
w AS (SELECT d.lang, d.doc_id AS item, k.k, (CAST('0x' || substr(md5('42:shot:' || d.doc_id), 1, 8) AS BIGINT) + k.k) % c.n AS at
  FROM documents d JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) c USING (lang), (SELECT unnest(range(5)) AS k) k WHERE k.k < c.n)
SELECT w.lang, w.item, s.support, w.k + 1 AS shot_rank FROM w JOIN s ON s.lang = w.lang AND s.at = w.at"""


# Mixing and splits.
def by_language(spark, sf_dir) -> list[DataFrame]:
    """A dataset for each language, documents without one included."""
    d = docs(spark, sf_dir).select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang"))
    langs = sorted(r["lang"] for r in d.select("lang").distinct().collect())
    return [mixing.number_rows(d.where(F.col("lang") == lang), [F.col("doc_id")]) for lang in langs]


def mixed(spark, sf_dir, strategy, probabilities=None):
    return mixing.mix(by_language(spark, sf_dir), strategy, probabilities, SEED).select("doc_id", "lang", "mix_pos")


LANGS = """WITH c AS (SELECT doc_id, coalesce(lang, 'none') AS lang FROM documents),
o AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS i, count(*) OVER () AS langs FROM (SELECT DISTINCT lang FROM c)),
d AS (SELECT doc_id, lang, i, langs, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS rid, count(*) OVER (PARTITION BY lang) AS n FROM c JOIN o USING (lang))
"""


def mix_concat(spark, sf_dir):
    return mixed(spark, sf_dir, "concat")


MIX_CONCAT = LANGS + "SELECT doc_id, lang, row_number() OVER (ORDER BY i, rid) - 1 AS mix_pos FROM d"


def mix_interleave_under(spark, sf_dir):
    return mixed(spark, sf_dir, "interleave_under")


MIX_INTERLEAVE_UNDER = LANGS + "SELECT doc_id, lang, rid * langs + i AS mix_pos FROM d WHERE rid < (SELECT min(n) FROM d)"


def mix_interleave_over(spark, sf_dir):
    return mixed(spark, sf_dir, "interleave_over")


MIX_INTERLEAVE_OVER = LANGS + "SELECT d.doc_id, d.lang, k.k * d.langs + d.i AS mix_pos FROM d JOIN (SELECT unnest(range((SELECT max(n) FROM d))) AS k) k ON k.k % d.n = d.rid"


def mix_interleave_probs(spark, sf_dir):
    """A language's share is in proportion to one, two, three, ... from the last one on."""
    parts = by_language(spark, sf_dir)
    shares = [float(len(parts) - i) for i in range(len(parts))]
    return mixing.mix(parts, "interleave_under", shares, SEED).select("doc_id", "lang", "mix_pos")


MIX_INTERLEAVE_PROBS = (
    LANGS
    + """, b AS (SELECT i, sum(CAST(langs - i AS DOUBLE) / (langs * (langs + 1) / 2)) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS high, langs FROM o),
u AS (SELECT k, CAST('0x' || substr(md5('42:mix:' || k), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM (SELECT unnest(range(8 * (SELECT count(*) FROM documents) + 1000)) AS k)),
p AS (SELECT k, coalesce((SELECT min(i) FROM b WHERE u.u < b.high), (SELECT max(i) FROM b)) AS i FROM u),
q AS (SELECT k, i, row_number() OVER (PARTITION BY i ORDER BY k) - 1 AS pick FROM p),
e AS (SELECT min(k) AS stop FROM q JOIN (SELECT i, max(n) AS n FROM d GROUP BY i) z USING (i) WHERE pick + 1 = n)
SELECT d.doc_id, d.lang, q.k AS mix_pos FROM q JOIN d ON d.i = q.i AND d.rid = q.pick % d.n WHERE q.k <= (SELECT stop FROM e)"""
)


def split_rows(spark, sf_dir, val_size):
    parts = mixing.split(docs(spark, sf_dir).select("doc_id"), val_size, "doc_id", SEED)
    return parts["train"].withColumn("part", F.lit("train")).unionByName(parts["validation"].withColumn("part", F.lit("validation")))


def spl_fraction(spark, sf_dir):
    return split_rows(spark, sf_dir, 0.13)


SPL_SQL = "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= {n} THEN 'validation' ELSE 'train' END AS part FROM documents"
SPL_FRACTION = SPL_SQL.format(n="ceil(0.13 * (SELECT count(*) FROM documents))")


def spl_count(spark, sf_dir):
    return split_rows(spark, sf_dir, 25)


SPL_COUNT = SPL_SQL.format(n="25")


# Statistics.
def agg_len_hist(spark, sf_dir):
    return metrics.length_histogram(docs(spark, sf_dir), F.length("text")).select("bucket", "n")


AGG_LEN_HIST = "SELECT CAST(length(text) // 1000 * 1000 AS BIGINT) AS bucket, count(*) AS n FROM documents GROUP BY 1"


def agg_len_cdf(spark, sf_dir):
    return metrics.length_histogram(docs(spark, sf_dir), F.length("text")).select("bucket", "running", r6(F.col("percent"), "percent"))


AGG_LEN_CDF = f"SELECT bucket, CAST(sum(n) OVER w AS BIGINT) AS running, round(100.0 * sum(n) OVER w / sum(n) OVER (), 6) AS percent FROM ({AGG_LEN_HIST}) WINDOW w AS (ORDER BY bucket ROWS UNBOUNDED PRECEDING)"


def agg_lr(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.length("text").alias("n"))
    rate = metrics.learning_rate(F.lit(2048.0), F.lit(16.0), F.least(F.col("n") / 2048, F.lit(1.0)), F.col("doc_id") % 2 == 0)
    return d.select("doc_id", F.round(rate * 1e6, 6).alias("rate_e6"))


AGG_LR = "SELECT doc_id, round(1e6 * 3e-4 * sqrt(2048.0::DOUBLE * 16 * least(length(text) / 2048.0::DOUBLE, 1.0) / 4e6) / CASE WHEN doc_id % 2 = 0 THEN 6.0 ELSE 1.0 END, 6) AS rate_e6 FROM documents"


def agg_tps(spark, sf_dir):
    out = metrics.tokens_per_second(docs(spark, sf_dir), [F.length("text").cast("long")], 3.0, 120.0, 8)
    return out.select("tokens", r6(F.col("tokens_per_second"), "tokens_per_second"))


AGG_TPS = "SELECT CAST(sum(length(text)) AS BIGINT) AS tokens, round(sum(length(text)) * 3.0::DOUBLE / 120.0 / 8, 6) AS tokens_per_second FROM documents"


def logits(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def top_argmax_choice(spark, sf_dir):
    return logits(spark, sf_dir).select("vec_id", metrics.choice_letter(F.slice("v", 1, 4)).alias("choice"), long(metrics.argmax(F.col("v")), "token"))


TOP_ARGMAX_CHOICE = "SELECT vec_id, substr('ABCD', list_position(embedding[1:4], list_max(embedding[1:4])), 1) AS choice, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS token FROM embeddings"


def agg_tok_acc(spark, sf_dir):
    """Turns' lengths modulo 3 as predictions, modulo 2 as labels of the odd turns."""
    t = F.sort_array(F.collect_list(F.struct("turn", F.length("text").alias("n"))))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(t.alias("t"))
    predictions = F.transform("t", lambda x: x["n"] % 3)
    labels = F.transform("t", lambda x, i: F.when(i % 2 == 1, x["n"] % 2).otherwise(IGNORE))
    accuracy = metrics.token_accuracy(predictions, labels)
    return rows.select("conv_id", F.when(~F.isnan(accuracy), F.round(accuracy, 6)).alias("accuracy"))


AGG_TOK_ACC = """WITH t AS (SELECT conv_id, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
SELECT a.conv_id, round(CAST(count(*) FILTER (b.i % 2 = 1 AND a.n % 3 = b.n % 2) AS DOUBLE) / nullif(count(*) FILTER (b.i % 2 = 1), 0), 6) AS accuracy
FROM t a LEFT JOIN t b ON b.conv_id = a.conv_id AND b.i = a.i + 1 GROUP BY 1"""


def agg_rm_acc(spark, sf_dir):
    v = logits(spark, sf_dir)
    return v.agg(r6(F.avg((F.col("v")[0] > F.col("v")[1]).cast("double")), "accuracy"), r6(F.avg(preference.reward_loss(F.col("v")[0], F.col("v")[1])), "loss"))


AGG_RM_ACC = "SELECT round(avg(CASE WHEN embedding[1] > embedding[2] THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(ln(1 + exp(-(embedding[1]::DOUBLE - embedding[2]::DOUBLE)))), 6) AS loss FROM embeddings"


def agg_ppl_seq(spark, sf_dir):
    rows = logits(spark, sf_dir)
    nll, labels = F.transform("v", lambda x: F.abs(x)), F.transform("v", lambda x, i: F.when(i % 3 == 0, IGNORE).otherwise(i))
    return rows.select("vec_id", r6(metrics.sequence_perplexity(nll, labels), "perplexity"))


AGG_PPL_SEQ = """WITH x AS (SELECT vec_id, abs(unnest(embedding)::DOUBLE) AS x, generate_subscripts(embedding, 1) AS i, len(embedding) AS n FROM embeddings)
SELECT vec_id, round(exp(avg(x)), 6) AS perplexity FROM x WHERE i < n AND i % 3 <> 0 GROUP BY vec_id"""


def agg_category_acc(spark, sf_dir):
    """Sources stand for subjects, the lengths of their names for categories."""
    rows = docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").withColumnRenamed("source", "subject")
    mapping = rows.select("subject", F.concat(F.lit("c"), F.length("subject") % 3).alias("category")).distinct()
    out = metrics.category_accuracy(readers.with_category(rows, mapping), "category", F.col("quality") == 1)
    return out.select("category", r6(F.col("accuracy"), "accuracy"), long(F.col("n"), "n"))


AGG_CATEGORY_ACC = """WITH d AS (SELECT 'c' || length(source) % 3 AS c, quality FROM documents JOIN labels USING (doc_id) WHERE source IS NOT NULL)
SELECT CASE WHEN grouping(c) = 1 THEN 'Average' ELSE c END AS category, round(100.0 * avg(CAST(quality = 1 AS INTEGER)), 6) AS accuracy, count(*) AS n FROM d GROUP BY ROLLUP (c)"""


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events")


def agg_avg_meter(spark, sf_dir):
    out = metrics.running_average(events(spark, sf_dir).withColumn("w", F.col("user_id") % 5 + 1), "value", "w", "event_type", "event_id")
    return out.select("event_id", F.round(F.col("average") + 1e-7, 3).alias("average"))


AGG_AVG_METER = "SELECT event_id, round(sum(value * (user_id % 5 + 1)) OVER w / sum(user_id % 5 + 1) OVER w + 1e-7, 3) AS average FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)"


def win_ema(spark, sf_dir):
    rows = metrics.smoothed_rows(events(spark, sf_dir).select("user_id", "ts", "event_id", "value"), "value", ["ts", "event_id"], "user_id")
    steps = mixing.running_sums(rows, [F.col("ts"), F.col("event_id")], {"step": F.lit(1)}, ["user_id"])
    return steps.select("user_id", long(F.col("step") - 1, "step"), F.round("smoothed", 4).alias("smoothed"))


WIN_EMA = """WITH RECURSIVE x AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, 1.8 * (1 / (1 + exp(-0.05 * count(*) OVER (PARTITION BY user_id))) - 0.5) AS w FROM events),
s AS (SELECT user_id, step, w * value + (1 - w) * value AS smoothed FROM x WHERE step = 0 UNION ALL SELECT x.user_id, x.step, s.smoothed * x.w + (1 - x.w) * x.value FROM s JOIN x ON x.user_id = s.user_id AND x.step = s.step + 1)
SELECT user_id, step, round(smoothed, 4) AS smoothed FROM s"""


def numbered_events(spark, sf_dir, *order) -> DataFrame:
    """Events with their number among those of their kind, and how many these are."""
    made = mixing.running_sums(events(spark, sf_dir), [F.col(c) for c in order], {"current": F.lit(1)}, ["event_type"])
    return made.join(made.groupBy("event_type").agg(F.max("current").alias("total")), "event_type")


def win_eta(spark, sf_dir):
    rows = numbered_events(spark, sf_dir, "ts", "event_id")
    made = metrics.progress(F.col("current"), F.col("total"), F.col("current").cast("long") * 37)
    return rows.select("event_id", *(c.alias(n) for n, c in made.items()))


_CLOCK = "CASE WHEN {s} >= 86400 THEN ({s} // 86400) || CASE WHEN {s} // 86400 = 1 THEN ' day, ' ELSE ' days, ' END ELSE '' END || printf('%d:%02d:%02d', {s} % 86400 // 3600, {s} % 3600 // 60, {s} % 60)"
WIN_ETA = f"""WITH x AS (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS c, count(*) OVER (PARTITION BY event_type) AS t FROM events)
SELECT event_id, round_even(CAST(c AS DOUBLE) / t * 100, 2) AS percentage, {_CLOCK.format(s="(c * 37)")} AS elapsed_time, {_CLOCK.format(s="((t - c) * 37)")} AS remaining_time FROM x"""


def lim_page_log(spark, sf_dir):
    """The latest event of each kind."""
    latest = readers.latest_record(events(spark, sf_dir).select("event_type", "event_id", "ts"), ("ts", "event_id"), ("event_type",))
    return latest.select("event_type", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


def jn_pred_label(spark, sf_dir):
    """Prompts, predictions and labels of three tables that share nothing but a row number."""
    turns = table(spark, sf_dir, "conversations").where("turn < 2")
    rows = turns.select(F.col("conv_id").alias("rid"), "turn", "text")
    asked, said = rows.where("turn = 0").select("rid", F.col("text").alias("prompt")), rows.where("turn = 1").select("rid", F.col("text").alias("predict"))
    wanted = docs(spark, sf_dir).select(F.col("doc_id").alias("rid"), F.col("text").alias("label"))
    out = sinks.joined_predictions(asked, said, wanted)
    return out.select("rid", F.md5(F.concat_ws("|", F.coalesce("prompt", F.lit("")), F.coalesce("predict", F.lit("")), F.coalesce("label", F.lit("")))).alias("row_md5"))


JN_PRED_LABEL = """SELECT p.conv_id AS rid, md5(concat_ws('|', coalesce(p.text, ''), coalesce(a.text, ''), coalesce(d.text, ''))) AS row_md5
FROM conversations p JOIN conversations a ON a.conv_id = p.conv_id AND a.turn = 1 JOIN documents d ON d.doc_id = p.conv_id WHERE p.turn = 0"""


def win_throughput(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", F.round(F.col("value") * 100).cast("long").alias("total_tokens"), (F.col("event_id") % 4).alias("elapsed_seconds"))
    return metrics.throughput(e).select("event_id", "throughput")


WIN_THROUGHPUT = "SELECT event_id, CASE WHEN event_id % 4 > 0 THEN round_even(CAST(CAST(round(value * 100) AS BIGINT) AS DOUBLE) / (event_id % 4), 2) END AS throughput FROM events"


LIM_PAGE_LOG = "SELECT event_type, arg_max(event_id, (ts, event_id)) AS event_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS at FROM events GROUP BY 1"


def win_sample_5(spark, sf_dir):
    rows = numbered_events(spark, sf_dir, "event_id").where("current % 5 = 0")
    return rows.select("event_type", "event_id", long(F.col("current"), "step"))


WIN_SAMPLE_5 = "SELECT event_type, event_id, step FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS step FROM events) WHERE step % 5 = 0"


def win_last_token(spark, sf_dir):
    mask = F.transform("v", lambda x, i: F.when(i < F.col("label") + 3, 1).otherwise(0))
    return logits(spark, sf_dir).select("vec_id", r6(metrics.at_last_token(F.col("v"), mask), "value"))


WIN_LAST_TOKEN = "SELECT vec_id, round(embedding[label + 3]::DOUBLE, 6) AS value FROM embeddings"


def flt_log_loss(spark, sf_dir):
    from loomspark.sources.readers import with_loss

    log = events(spark, sf_dir).withColumn("loss", F.when(F.col("event_id") % 7 != 0, F.col("value")).when(F.col("event_id") % 2 == 0, F.lit(0.0)))
    return with_loss(log).select("event_id", F.round("loss", 4).alias("loss"))


FLT_LOG_LOSS = "SELECT event_id, round(value, 4) AS loss FROM events WHERE event_id % 7 <> 0 AND value <> 0"


def agg_mfu(spark, sf_dir):
    """Closed-form operations of a step, with sizes made of the part table."""
    p = table(spark, sf_dir, "part").select("p_partkey", *(F.lit(x).cast("double").alias(n) for n, x in (("hidden", 4096), ("vocab", 32000), ("intermediate", 11008), ("heads", 32), ("kv_heads", 8), ("layers", 32))))
    p = p.withColumns({"batch": (F.col("p_partkey") % 8 + 1).cast("double"), "seq": (F.col("p_partkey") % 4 * 512 + 512).cast("double"), "tied": F.col("p_partkey") % 2 == 0})
    flops = metrics.model_flops({c: F.col(c) for c in p.columns})
    return p.select("p_partkey", F.round(flops / 1e9, 3).alias("gflops"), F.round(metrics.utilisation(F.lit(0.1), flops, "A100", 8) * 1e3, 6).alias("utilisation_e3"))


AGG_MFU = """WITH p AS (SELECT p_partkey, (p_partkey % 8 + 1)::DOUBLE AS b, (p_partkey % 4 * 512 + 512)::DOUBLE AS s, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END AS e FROM part),
f AS (SELECT p_partkey, 3 * (6.0::DOUBLE * 4096 * 11008 * b * s * 32 + (4.0::DOUBLE * 4096 * 4096 + 2 * 2.0 * 4096 * 4096 * 8 / 32) * b * s * 32 + 4.0::DOUBLE * 4096 * s * s * b * 32) + 3 * 4096.0::DOUBLE * 32000 * b * s * e AS f FROM p)
SELECT p_partkey, round(f / 1e9, 3) AS gflops, round(0.1 * f / (312e12 * 8) * 1e3, 6) AS utilisation_e3 FROM f"""


# Preference losses over log-probabilities made of vectors.
def logps(spark, sf_dir) -> DataFrame:
    v = logits(spark, sf_dir)
    value = lambda i: (-F.abs(F.col("v")[i]) - 0.01)
    return v.select("vec_id", "label", value(0).alias("chosen"), value(1).alias("rejected"), value(2).alias("ref_chosen"), value(3).alias("ref_rejected"))


L = "(SELECT vec_id, label, -abs(embedding[1]::DOUBLE) - 0.01 AS c, -abs(embedding[2]::DOUBLE) - 0.01 AS r, -abs(embedding[3]::DOUBLE) - 0.01 AS rc, -abs(embedding[4]::DOUBLE) - 0.01 AS rr FROM embeddings)"
SIG = "(-ln(1 + exp(-({x}))))"


def ls_preference(spark, sf_dir):
    c, r, rc, rr = (F.col(x) for x in ("chosen", "rejected", "ref_chosen", "ref_rejected"))
    return logps(spark, sf_dir).select(
        "vec_id",
        r6(preference.orpo_loss(c, r), "orpo"),
        r6(preference.simpo_loss(c, r), "simpo"),
        r6(preference.dpo_loss(c, r, rc, rr, "sigmoid", smoothing=0.1), "dpo"),
        r6(preference.dpo_loss(c, r, rc, rr, "hinge"), "hinge"),
        r6(preference.dpo_loss(c, r, rc, rr, "ipo"), "ipo"),
        r6(preference.kto_loss(c, rc, F.col("label") % 2 == 0, F.lit(0.05)), "kto"),
        r6(preference.reward_loss(c, r), "reward"),
        r6(preference.with_tuning_term(preference.dpo_loss(c, r, rc, rr), c, 0.5), "dpo_tuned"),
    )


LS_PREFERENCE = f"""SELECT vec_id,
  round(-c - 0.1 * {SIG.format(x="(c - r) - (ln(1 - exp(c)) - ln(1 - exp(r)))")}, 6) AS orpo,
  round(-{SIG.format(x="0.1 * ((c - r) - 5.0)")}, 6) AS simpo,
  round(-{SIG.format(x="0.1 * ((c - r) - (rc - rr))")} * 0.9 - {SIG.format(x="-0.1 * ((c - r) - (rc - rr))")} * 0.1, 6) AS dpo,
  round(greatest(1 - 0.1 * ((c - r) - (rc - rr)), 0), 6) AS hinge,
  round(pow((c - r) - (rc - rr) - 5.0, 2), 6) AS ipo,
  round(1 - exp({SIG.format(x="CASE WHEN label % 2 = 0 THEN 0.1 * (c - rc - 0.05) ELSE 0.1 * (0.05 - (c - rc)) END")}), 6) AS kto,
  round(-{SIG.format(x="c - r")}, 6) AS reward,
  round(-{SIG.format(x="0.1 * ((c - r) - (rc - rr))")} - 0.5 * c, 6) AS dpo_tuned
FROM {L}"""


def ls_rewards(spark, sf_dir):
    out = preference.reward_summary(logps(spark, sf_dir), "label")
    return out.select(long(F.col("label"), "label"), *(r6(F.col(c), c) for c in out.columns if c != "label"))


LS_REWARDS = f"""SELECT CAST(label AS BIGINT) AS label, round(avg(0.1 * (c - rc)), 6) AS rewards_chosen, round(avg(0.1 * (r - rr)), 6) AS rewards_rejected,
  round(avg(CASE WHEN 0.1 * (c - rc) > 0.1 * (r - rr) THEN 1.0 ELSE 0.0 END), 6) AS rewards_accuracy, round(avg(0.1 * (c - rc) - 0.1 * (r - rr)), 6) AS rewards_margin,
  round(avg(c), 6) AS logps_chosen, round(avg(r), 6) AS logps_rejected FROM {L} GROUP BY 1"""


def ls_batch_logps(spark, sf_dir):
    rows = logits(spark, sf_dir)
    total, n = preference.sequence_logp(F.transform("v", lambda x: -F.abs(x)), F.transform("v", lambda x, i: F.when(i % 3 == 0, IGNORE).otherwise(i)))
    return rows.select("vec_id", r6(total, "logp"), long(n, "length"), r6(preference.normalised(total, n, "ipo"), "mean_logp"))


LS_BATCH_LOGPS = """WITH x AS (SELECT vec_id, -abs(unnest(embedding)::DOUBLE) AS x, generate_subscripts(embedding, 1) AS i, len(embedding) AS n FROM embeddings)
SELECT vec_id, round(sum(x), 6) AS logp, count(*) AS length, round(avg(x), 6) AS mean_logp FROM x WHERE i < n AND i % 3 <> 0 GROUP BY vec_id"""


def ls_ppo_trim(spark, sf_dir):
    ids = F.concat(F.array_repeat(F.lit(0), F.col("label")), F.array(F.lit(5), F.lit(0), F.lit(7)), F.array_repeat(F.lit(0), F.col("label") + 1))
    rows = logits(spark, sf_dir).withColumn("ids", ids)
    return rows.select("vec_id", long(F.size(preference.trim_left(F.col("ids"), 0)), "query_length"), long(F.size(preference.trim_right(F.col("ids"), 0, 0)), "response_length"), long(F.size(preference.trim_right(F.col("ids"), 0, 9)), "response_length_other"))


LS_PPO_TRIM = "SELECT vec_id, CAST(label + 4 AS BIGINT) AS query_length, CAST(label + 4 AS BIGINT) AS response_length, CAST(label + 3 AS BIGINT) AS response_length_other FROM embeddings"


def snk_predictions_rm(spark, sf_dir):
    v = logits(spark, sf_dir).select("vec_id", F.col("v")[0].alias("chosen"), F.col("v")[1].alias("rejected"))
    scores = sinks.pair_scores(v, ["vec_id"])
    return scores.select("vec_id", (F.col("chosen") + 0.0).alias("chosen"), (F.col("rejected") + 0.0).alias("rejected"))


SNK_PREDICTIONS_RM = "SELECT vec_id, round_even(embedding[1]::DOUBLE, 2) + 0.0 AS chosen, round_even(embedding[2]::DOUBLE, 2) + 0.0 AS rejected FROM embeddings"


# Media.
def pictures(spark, sf_dir) -> DataFrame:
    """Widths, heights and lengths made of document ids."""
    return docs(spark, sf_dir).select("doc_id", (F.col("doc_id") * 37 % 2500 + 10).cast("int").alias("w"), (F.col("doc_id") * 53 % 1900 + 10).cast("int").alias("h"))


P = "(SELECT doc_id, CAST(doc_id * 37 % 2500 + 10 AS INTEGER) AS w, CAST(doc_id * 53 % 1900 + 10 AS INTEGER) AS h FROM documents)"


def mm_resize(spark, sf_dir):
    w, h = multimodal.resized(F.col("w"), F.col("h"))
    return pictures(spark, sf_dir).select("doc_id", long(w, "width"), long(h, "height"))


MM_RESIZE = f"""WITH a AS (SELECT doc_id, CASE WHEN w * h > 589824 THEN floor(w * sqrt(589824.0::DOUBLE / (w::DOUBLE * h))) ELSE w END AS w, CASE WHEN w * h > 589824 THEN floor(h * sqrt(589824.0::DOUBLE / (w::DOUBLE * h))) ELSE h END AS h FROM {P})
SELECT doc_id, CAST(CASE WHEN w * h < 1024 THEN floor(w * sqrt(1024.0::DOUBLE / (w::DOUBLE * h))) ELSE w END AS BIGINT) AS width, CAST(CASE WHEN w * h < 1024 THEN floor(h * sqrt(1024.0::DOUBLE / (w::DOUBLE * h))) ELSE h END AS BIGINT) AS height FROM a"""


def mm_token_counts(spark, sf_dir):
    w, h = F.col("w"), F.col("h")
    wide, high = multimodal.vision_sides(w, h)
    image, video = multimodal.frame_tokens(w, h, 14, F.lit(8))
    return pictures(spark, sf_dir).select(
        "doc_id",
        long(multimodal.video_average_tokens(w, h, 14, F.lit(8)), "averaged"),
        long(image, "image"),
        long(video, "video"),
        long(multimodal.grid_tokens(F.lit(1), F.floor(h / 14), F.floor(w / 14)), "grid"),
        long(multimodal.audio_tokens(w), "audio"),
        long(F.length(multimodal.row_tokens(F.greatest(w, F.lit(16)), F.greatest(h, F.lit(16)), 16, "i", "b", "e")), "rows"),
        long(wide, "wide"),
        long(high, "high"),
    )


MM_TOKEN_COUNTS = f"""SELECT doc_id, CAST((h // 14) * (w // 14) // 4 * 8 AS BIGINT) AS averaged, CAST((h // 14) * (w // 14) AS BIGINT) AS image, CAST(((h // 14) * (w // 14) + 1) * 8 AS BIGINT) AS video,
  CAST((h // 14) * (w // 14) // 4 AS BIGINT) AS grid, CAST(((w - 1) // 2 + 1 - 2) // 2 + 1 AS BIGINT) AS audio,
  CAST((greatest(h, 16) // 16) * (greatest(w, 16) // 16 + 1) AS BIGINT) AS rows,
  CAST(CASE WHEN greatest(w, CASE WHEN least(w, h) < 28 THEN 28 ELSE w END) > 200 * greatest(h, CASE WHEN least(w, h) < 28 THEN 28 ELSE h END) THEN greatest(h, 28) * 180 ELSE greatest(w, CASE WHEN least(w, h) < 28 THEN 28 ELSE w END) END AS BIGINT) AS wide,
  CAST(greatest(h, CASE WHEN least(w, h) < 28 THEN 28 ELSE h END) AS BIGINT) AS high FROM {P}"""


def mm_frame_idx(spark, sf_dir):
    idx = multimodal.frame_indices(F.col("w"), F.col("h") / 10.0)
    return pictures(spark, sf_dir).select("doc_id", long(F.size(idx), "frames"), long(F.aggregate(idx, F.lit(0).cast("long"), lambda a, x: a + x), "index_sum"), long(F.try_element_at(idx, F.lit(-1)), "last"))


MM_FRAME_IDX = f"""WITH a AS (SELECT doc_id, w, CAST(least(w, 128, floor(h / 10.0::DOUBLE * 2.0)) AS BIGINT) AS n FROM {P}),
b AS (SELECT doc_id, w, n, list_transform(range(n), lambda i: CASE WHEN n = 1 THEN 0 ELSE CAST(floor(i * ((w - 1)::DOUBLE / greatest(n - 1, 1))) AS BIGINT) END) AS x FROM a)
SELECT doc_id, n AS frames, CAST(coalesce(list_sum(x), 0) AS BIGINT) AS index_sum, CAST(x[-1] AS BIGINT) AS last FROM b"""


def mm_placeholders(spark, sf_dir):
    """A placeholder put in front of every question, then counted and expanded."""
    rows = canonical(spark, sf_dir).where("size(_prompt) > 0")
    put = F.transform("_prompt", lambda m: F.struct(m["role"].alias("role"), F.when(m["role"] == "user", F.concat(F.lit("<image>"), m["content"])).otherwise(m["content"]).alias("content")))
    rows = rows.withColumn("messages", put)
    images = multimodal.placeholders(F.col("messages"), "<image>")
    counts = F.transform(F.sequence(F.lit(1), F.greatest(images, F.lit(1))), lambda i: i * 2)
    filled = multimodal.expand_counted(F.col("messages"), "<image>", "#", counts, "[", "]")
    flat = multimodal.expand_uniform(F.col("messages"), "<image>", "#", 5)
    text = lambda c: F.array_join(F.transform(c, lambda m: m["content"]), "|")
    return rows.select("conv_id", long(images, "images"), F.md5(text(filled)).alias("expanded_md5"), long(F.length(text(flat)), "flat_chars"))


def _mm_sql() -> str:
    from loomspark.plans.tables import V

    return (
        V
        + """, w AS (SELECT conv_id, i, n, m[i].text AS x, i % 2 = 1 AS u FROM (SELECT *, unnest(range(1, n)) AS i FROM v WHERE ok AND n % 2 = 0 AND n > 0))
SELECT conv_id, count(*) FILTER (u) AS images, md5(string_agg(CASE WHEN u THEN '[' || repeat('#', (i + 1) // 2 * 2) || ']' || x ELSE x END, '|' ORDER BY i)) AS expanded_md5,
  CAST(sum(length(x) + CASE WHEN u THEN 5 ELSE 0 END) + count(*) - 1 AS BIGINT) AS flat_chars FROM w GROUP BY conv_id"""
    )


MM_PLACEHOLDERS = _mm_sql()


# Evaluation prompts.
def questions(spark, sf_dir) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.col("lang").alias("subject"), F.col("source").alias("question"), F.lit("one").alias("A"), F.col("lang").alias("B"), F.lit("three").alias("C"), F.lit(None).cast("string").alias("D"), F.element_at(F.array(*(F.lit(c) for c in "ABCD")), (F.col("doc_id") % 4 + 1).cast("int")).alias("answer"))


def ev_format(spark, sf_dir):
    """Five-shot prompts of every document's question, shots from its own language."""
    q = questions(spark, sf_dir)
    q = q.select("doc_id", "subject", evaluation.question_text({c: F.col(c) for c in ("question", "A", "B", "C", "D")}).alias("prompt"), "answer")
    shots = mixing.few_shot(q.select("subject", F.col("doc_id").alias("item")), q.select("subject", F.col("doc_id").alias("support")), "subject", "item", "support", 5, SEED)
    given = shots.join(q.select(F.col("doc_id").alias("support"), "prompt", "answer"), "support").select("item", "subject", F.col("shot_rank").alias("at"), "prompt", "answer")
    own = q.select(F.col("doc_id").alias("item"), "subject", F.lit(99).alias("at"), "prompt", "answer")
    made = evaluation.prompts(given.unionByName(own), ["item"], "at")
    text = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return made.select("item", long(F.size("messages"), "n_messages"), F.md5(text).alias("text_md5"))


EV_FORMAT = f"""WITH q AS (SELECT doc_id, lang, source || chr(10) || 'A. one' || chr(10) || 'B. ' || lang || chr(10) || 'C. three' || chr(10) || 'Answer:' AS prompt, substr('ABCD', CAST(doc_id % 4 + 1 AS INTEGER), 1) AS answer FROM documents),
f AS ({SMP_FEWSHOT}), a AS (SELECT f.item, f.lang, f.shot_rank AS nth, q.prompt, q.answer FROM f JOIN q ON q.doc_id = f.support UNION ALL SELECT doc_id, lang, 99, prompt, answer FROM q)
SELECT item, count(*) * 2 AS n_messages, md5(string_agg('user:' || CASE WHEN nth = first THEN 'The following are multiple choice questions (with answers) about ' || lang || '.' || chr(10) || chr(10) ELSE '' END || prompt || '|assistant:' || answer, '|' ORDER BY nth)) AS text_md5
FROM (SELECT *, min(nth) OVER (PARTITION BY item) AS first FROM a) GROUP BY item"""


# Serving.
def api_normalise(spark, sf_dir):
    """Conversations written as requests and read back."""
    turn = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    rows = chats(spark, sf_dir).select("conv_id", F.to_json(F.struct(F.lit("m").alias("model"), turn.alias("messages"))).alias("body"))
    out = serving.normalise(rows.select("conv_id", serving.parse_requests(F.col("body")).alias("request")))
    text = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return out.select("conv_id", "valid", F.md5(F.coalesce("system", F.lit(""))).alias("system_md5"), long(F.size("messages"), "n"), F.md5(text).alias("text_md5"))


def _api_sql() -> str:
    from loomspark.plans.tables import V

    return V + "SELECT conv_id, ok AND n % 2 = 1 AS valid, md5(system) AS system_md5, CAST(n AS BIGINT) AS n, md5(coalesce(array_to_string(list_transform(m, lambda x: x.role || ':' || x.text), '|'), '')) AS text_md5 FROM v"


API_NORMALISE = _api_sql()


def api_usage(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    answers = turns.where("role = 'assistant'").select("conv_id", F.lit(7).alias("prompt_length"), F.length("text").alias("response_length"))
    out = serving.usage(answers, "conv_id")
    return out.select("conv_id", *(long(F.col(c), c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")))


API_USAGE = "SELECT conv_id, CAST(7 AS BIGINT) AS prompt_tokens, CAST(sum(length(text)) AS BIGINT) AS completion_tokens, CAST(sum(length(text)) + 7 AS BIGINT) AS total_tokens FROM conversations WHERE role = 'assistant' GROUP BY 1"


def api_stream(spark, sf_dir):
    """Answers that grow turn by turn, as deltas and a closing mark."""
    upto = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    grown = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.collect_list("text").over(upto), "").alias("text"))
    return serving.deltas(grown, "conv_id", "turn").select("conv_id", "turn", F.md5("delta").alias("delta_md5"))


API_STREAM = "SELECT conv_id, turn, md5(text) AS delta_md5 FROM conversations WHERE text <> '' UNION ALL SELECT conv_id, max(turn) + 1, md5('[DONE]') FROM conversations GROUP BY 1"


def api_resp_len(spark, sf_dir):
    ids = F.transform(F.sequence(F.lit(1), F.col("label") + 5), lambda i: F.when(i == F.col("vec_id") % 11, 2).otherwise(i + 10).cast("int"))
    n, reason = serving.response_length(ids, 2)
    return logits(spark, sf_dir).select("vec_id", long(n, "n"), reason.alias("reason"))


API_RESP_LEN = "SELECT vec_id, CAST(CASE WHEN vec_id % 11 BETWEEN 1 AND label + 5 THEN vec_id % 11 ELSE label + 5 END AS BIGINT) AS n, CASE WHEN vec_id % 11 BETWEEN 1 AND label + 5 THEN 'stop' ELSE 'length' END AS reason FROM embeddings"


def fmt_think_html(spark, sf_dir):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<think>"), F.col("source"), F.lit("</think>"), F.col("lang"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("<think>"), F.col("source"))).otherwise(F.col("lang"))
    thought, answer = serving.think_parts(text)
    return docs(spark, sf_dir).select("doc_id", thought.alias("thought"), answer.alias("answer"))


FMT_THINK_HTML = "SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN source END AS thought, CASE WHEN doc_id % 3 = 1 THEN '' ELSE lang END AS answer FROM documents"


def ex_gpa(spark, sf_dir):
    grade = lambda k: F.element_at(F.array(*(F.lit(g) for g in "ABC")), ((F.col("vec_id") + k) % 3 + 1).cast("int"))
    hours = F.array(*((F.col("label") + k).cast("double") for k in (1, 2, 3)))
    return logits(spark, sf_dir).select("vec_id", metrics.credit_mean(F.array(*(grade(k) for k in range(3))), hours, {"A": 4.0, "B": 3.0, "C": 2.0}).alias("mean"))


EX_GPA = "SELECT vec_id, round_even(((4 - vec_id % 3) * (label + 1) + (4 - (vec_id + 1) % 3) * (label + 2) + (4 - (vec_id + 2) % 3) * (label + 3))::DOUBLE / (3 * label + 6), 2) AS mean FROM embeddings"


# Operators whose logic is inherently sequential or needs exact JSON bytes.
def tool_formats(spark, sf_dir):
    """Each of the five formats renders a call made of a document and extracts it again."""
    call = F.concat(F.lit('{"name": "find", "arguments": {"id": '), F.col("doc_id").cast("string"), F.lit(', "lang": "'), F.col("lang"), F.lit('"}}'))
    rows, out = docs(spark, sf_dir).select("doc_id", call.alias("call")), []
    for name in tools.TOOL_FORMATS:
        text = rows.select("doc_id", F.lit(name).alias("format"), tools.calls_text(F.col("call"), name).alias("text"))
        out.append(text.select("doc_id", "format", "text", tools.extract_calls(F.col("text"), name).alias("calls")))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found.select("doc_id", "format", F.md5("text").alias("text_md5"), long(F.size("calls"), "n_calls"), F.col("calls")[0]["arguments"].alias("arguments"))


_ARGS = "'{\"id\": ' || doc_id || ', \"lang\": \"' || lang || '\"}'"
_CALL = f"'{{\"name\": \"find\", \"arguments\": ' || {_ARGS} || '}}'"
TOOL_FORMATS = f"""WITH t AS (
  SELECT doc_id, lang, 'default' AS format, 'Action: find' || chr(10) || 'Action Input: ' || {_ARGS} || chr(10) AS text FROM documents UNION ALL
  SELECT doc_id, lang, 'glm4', 'find' || chr(10) || {_ARGS} FROM documents UNION ALL
  SELECT doc_id, lang, 'llama3', '{{"name": "find", "parameters": ' || {_ARGS} || '}}' FROM documents UNION ALL
  SELECT doc_id, lang, 'mistral', '[' || {_CALL} || ']' FROM documents UNION ALL
  SELECT doc_id, lang, 'qwen', '<tool_call>' || chr(10) || {_CALL} || chr(10) || '</tool_call>' FROM documents)
SELECT doc_id, format, md5(text) AS text_md5, CAST(1 AS BIGINT) AS n_calls, {_ARGS} AS arguments FROM t"""


def agg_rouge_bleu(spark, sf_dir):
    """Each turn scored against the one before it."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", before.alias("label")).where("label is not null")
    return rows.select("conv_id", "turn", metrics.similarity_scores(F.col("text"), F.col("label")).alias("s")).select("conv_id", "turn", "s.*")


#: Letters as characters of a script without spaces.
LETTERS = ("abcdefghijklmnopqrstuvwxyz", "".join(map(chr, range(0x4E00, 0x4E1A))))


def agg_rouge_segmented(spark, sf_dir):
    """The same over texts without spaces, in characters that stand for letters: a dictionary of the
    words of documents cuts them."""
    unspaced = lambda c: F.regexp_replace(F.translate(F.lower(c), *LETTERS), f"[^{LETTERS[1][0]}-{LETTERS[1][-1]}]", "")
    # Words are counted as they stand; only distinct ones are rewritten.
    words = docs(spark, sf_dir).select(F.explode(F.split("text", r"\s+")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).select(unspaced(F.col("word")).alias("word"), "n")
    model = segmentation.train_segmenter(words)
    # Each text is cut once, before it serves as an answer and as the label of the next one.
    cut = segmentation.segmented(table(spark, sf_dir, "conversations").select("conv_id", "turn", unspaced(F.col("text")).alias("a")), model, "a", "x")
    said = cut.select("conv_id", "turn", F.array_join("x", " ").alias("x"))
    rows = said.withColumn("y", F.lag("x").over(Window.partitionBy("conv_id").orderBy("turn"))).where("y is not null")
    return rows.select("conv_id", "turn", metrics.similarity_scores(F.col("x"), F.col("y"), bleu=False).alias("s")).select("conv_id", "turn", "s.rouge_1", "s.rouge_2", "s.rouge_l")


def agg_rouge_bleu_parts(spark, sf_dir):
    """The scores that SQL can repeat: all but the longest common subsequence."""
    return agg_rouge_bleu(spark, sf_dir).drop("rouge_l")


AGG_ROUGE_BLEU_PARTS = """
WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS a, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
r AS (SELECT conv_id, turn, a, b, list_filter(string_split_regex(a, '\\s+'), lambda w: w <> '') AS x, list_filter(string_split_regex(b, '\\s+'), lambda w: w <> '') AS y FROM t WHERE b IS NOT NULL),
g AS (SELECT *, list_distinct(x) AS x1, list_distinct(y) AS y1, list_distinct(list_transform(range(1, len(x)), lambda i: x[i] || ' ' || x[i + 1])) AS x2,
  list_distinct(list_transform(range(1, len(y)), lambda i: y[i] || ' ' || y[i + 1])) AS y2 FROM r),
f AS (SELECT conv_id, turn, a, b, CASE WHEN len(x) > 0 AND len(y) > 0 THEN 200.0 * len(list_intersect(x1, y1)) / (len(x1) + len(y1)) ELSE 0 END AS rouge_1,
  CASE WHEN len(x2) + len(y2) > 0 AND len(x) > 0 AND len(y) > 0 THEN 200.0 * len(list_intersect(x2, y2)) / (len(x2) + len(y2)) ELSE 0 END AS rouge_2 FROM g),
n AS (SELECT unnest([1, 2, 3, 4]) AS n),
i AS (SELECT conv_id, turn, n, a, b, generate_subscripts(range(greatest(length(a), length(b))), 1) AS i FROM f, n),
ca AS (SELECT conv_id, turn, n, substring(a, i, n) AS s, count(*) AS k FROM i WHERE i + n - 1 <= length(a) GROUP BY ALL),
cb AS (SELECT conv_id, turn, n, substring(b, i, n) AS s, count(*) AS k FROM i WHERE i + n - 1 <= length(b) GROUP BY ALL),
h AS (SELECT f.conv_id, f.turn, n.n, greatest(length(a) - n + 1, 1) AS size, coalesce((SELECT sum(least(ca.k, cb.k)) FROM ca JOIN cb USING (conv_id, turn, n, s) WHERE ca.conv_id = f.conv_id AND ca.turn = f.turn AND ca.n = n.n), 0) AS hits FROM f, n),
z AS (SELECT *, count(*) FILTER (hits = 0) OVER (PARTITION BY conv_id, turn ORDER BY n) AS zeros FROM h),
e AS (SELECT conv_id, turn, exp(sum(ln(CASE WHEN hits > 0 THEN hits / size ELSE 1.0 / (pow(2, zeros) * size) END)) / 4) AS p, max(hits) FILTER (n = 1) AS first FROM z GROUP BY 1, 2)
SELECT conv_id, turn, round(rouge_1, 4) AS rouge_1, round(rouge_2, 4) AS rouge_2,
  round(CASE WHEN first > 0 THEN 100 * p * CASE WHEN length(a) > length(b) THEN 1.0 ELSE exp(1 - length(b) / length(a)) END ELSE 0 END, 4) AS bleu_4 FROM f JOIN e USING (conv_id, turn)
"""


def transcripts(spark, sf_dir) -> DataFrame:
    rows = canonical(spark, sf_dir).where("size(_prompt) > 0 and size(_response) = 1")
    mark = lambda a, b: F.array_join(F.transform("_prompt", lambda m: F.concat(F.when(m["role"] == "user", a).otherwise(b), m["content"])), "")
    return rows.select(
        "conv_id",
        F.concat(F.array_join(F.transform("_prompt", lambda m: F.concat(F.when(m["role"] == "user", "Human: ").otherwise("Assistant: "), m["content"])), "\n"), F.lit("\nAssistant:")).alias("instruction"),
        F.col("_response")[0]["content"].alias("output"),
        F.concat(mark(F.lit("\n\nHuman: "), F.lit("\n\nAssistant: ")), F.lit("\n\nAssistant: "), F.col("_response")[0]["content"]).alias("chosen"),
        F.concat(mark(F.lit("\n\nHuman: "), F.lit("\n\nAssistant: ")), F.lit("\n\nAssistant: no")).alias("rejected"),
        F.size("_prompt").alias("n"),
    )


def src_builder_belle(spark, sf_dir):
    out = builders.build_transcripts(transcripts(spark, sf_dir), keep=["conv_id"])
    return out.select("conv_id", long(F.size("conversations"), "n"), F.md5(F.array_join(F.transform("conversations", lambda m: F.concat(m["from"], F.lit(":"), m["value"])), "|")).alias("said_md5"))


def src_builder_hh(spark, sf_dir):
    out = builders.build_preferences(transcripts(spark, sf_dir), keep=["conv_id"])
    return out.select("conv_id", F.md5("instruction").alias("instruction_md5"), F.md5("chosen").alias("chosen_md5"), F.col("rejected"), long(F.size("history"), "n_history"))


def _builder_sql(body: str) -> str:
    from loomspark.plans.tables import V

    strip = r"regexp_replace(m[i].text, '^\s+|\s+$', '', 'g')"
    return V + f", w AS (SELECT conv_id, i, n, {strip} AS x FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM v WHERE ok AND n % 2 = 0 AND n > 0)) " + body


SRC_BUILDER_BELLE = _builder_sql("SELECT conv_id, count(*) AS n, md5(string_agg(CASE WHEN i % 2 = 1 THEN 'human' ELSE 'gpt' END || ':' || x, '|' ORDER BY i)) AS said_md5 FROM w GROUP BY conv_id")
SRC_BUILDER_HH = _builder_sql("SELECT conv_id, md5(max(x) FILTER (i = n - 1)) AS instruction_md5, md5(max(x) FILTER (i = n)) AS chosen_md5, 'no' AS rejected, CAST(max(n) // 2 - 1 AS BIGINT) AS n_history FROM w GROUP BY conv_id")


def snk_predictions_batch(spark, sf_dir):
    """Turn lengths as labels with every third ignored: what is left, and pads moved behind."""
    labels = F.transform("v", lambda x, i: F.when(i % 3 == 0, IGNORE).otherwise(i))
    ids = F.transform("v", lambda x, i: F.when(i < F.col("label"), 0).otherwise(i + 1))
    moved = sinks.pads_last(ids, 0)
    return logits(spark, sf_dir).select("vec_id", long(F.size(sinks.without_ignored(labels)), "n_labels"), long(F.element_at(moved, 1), "first_id"), long(F.element_at(moved, -1), "last_id"))


SNK_PREDICTIONS_BATCH = "SELECT vec_id, CAST(len(embedding) - (len(embedding) + 2) // 3 AS BIGINT) AS n_labels, CAST(label + 1 AS BIGINT) AS first_id, CAST(CASE WHEN label > 0 THEN 0 ELSE len(embedding) END AS BIGINT) AS last_id FROM embeddings"


def flt_catalog_ranking(spark, sf_dir):
    """A registry of the sources of labelled documents, filtered to what preference tuning can use:
    those with documents of both qualities."""
    from loomspark.sources.catalog import catalog_table, usable_datasets

    labelled = docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.countDistinct("quality").alias("kinds")).where("source is not null").collect()
    registry = {r["source"]: {"file_name": f"{r['source']}.parquet", "formatting": "sharegpt" if len(r["source"]) % 2 else "alpaca", "ranking": r["kinds"] > 1} for r in labelled}
    return usable_datasets(catalog_table(spark, registry), "rm").select("dataset", "formatting", "location")


FLT_CATALOG_RANKING = """SELECT source AS dataset, CASE WHEN length(source) % 2 = 1 THEN 'sharegpt' ELSE 'alpaca' END AS formatting, source || '.parquet' AS location
FROM documents JOIN labels USING (doc_id) WHERE source IS NOT NULL GROUP BY source HAVING count(DISTINCT quality) > 1"""


def agg_kto_log(spark, sf_dir):
    rows = logps(spark, sf_dir).withColumn("liked", F.col("vec_id") % 2 == 0)
    out = metrics.preference_log(rows, "label", "liked", ["chosen", "ref_chosen"])
    return out.select(long(F.col("label"), "label"), *(r6(F.col(c), c) for c in out.columns if c != "label"))


AGG_KTO_LOG = f"""SELECT CAST(label AS BIGINT) AS label, round(avg(c) FILTER (vec_id % 2 = 0), 6) AS chosen_chosen, round(avg(c) FILTER (vec_id % 2 = 1), 6) AS chosen_rejected,
  round(avg(c) FILTER (vec_id % 2 = 0) - avg(c) FILTER (vec_id % 2 = 1), 6) AS chosen_margin, round(avg(rc) FILTER (vec_id % 2 = 0), 6) AS ref_chosen_chosen,
  round(avg(rc) FILTER (vec_id % 2 = 1), 6) AS ref_chosen_rejected, round(avg(rc) FILTER (vec_id % 2 = 0) - avg(rc) FILTER (vec_id % 2 = 1), 6) AS ref_chosen_margin FROM {L} GROUP BY 1"""


def agg_dpo_log(spark, sf_dir):
    out = metrics.mean_of_batches(logps(spark, sf_dir).withColumn("batch", F.floor(F.col("vec_id") / 64)), "batch", ["chosen", "rejected"])
    return out.select(*(r6(F.col(c), c) for c in out.columns))


AGG_DPO_LOG = f"SELECT round(avg(c), 6) AS chosen, round(avg(r), 6) AS rejected FROM (SELECT vec_id // 64 AS b, avg(c) AS c, avg(r) AS r FROM {L} GROUP BY 1)"


def mm_plugins(spark, sf_dir):
    """One placeholder in front of every question, expanded as each counting plugin does."""
    rows = canonical(spark, sf_dir).where("size(_prompt) > 0")
    put = F.transform("_prompt", lambda m: F.struct(m["role"].alias("role"), F.when(m["role"] == "user", F.concat(F.lit("<image>"), m["content"])).otherwise(m["content"]).alias("content")))
    rows = rows.withColumn("messages", put).withColumn("counts", F.array_repeat(F.lit(4), F.size("_prompt")))
    out = {}
    for plugin, token in (("llava_next", "#"), ("qwen2_vl", "#"), ("mllama", "<|image|>"), ("paligemma", "#")):
        made = multimodal.process_messages(plugin, {"image": token}, F.col("messages"), {"image": F.col("counts")})
        out[plugin] = long(F.aggregate(made, F.lit(0), lambda a, m: a + F.length(m["content"])), plugin)
    return rows.select("conv_id", *out.values())


def _plugins_sql() -> str:
    from loomspark.plans.tables import V

    return (
        V
        + """, w AS (SELECT conv_id, i, m[i].text AS x, i % 2 = 1 AS u FROM (SELECT *, unnest(range(1, n)) AS i FROM v WHERE ok AND n % 2 = 0 AND n > 0))
SELECT conv_id, CAST(sum(length(x) + CASE WHEN u THEN 4 ELSE 0 END) AS BIGINT) AS llava_next, CAST(sum(length(x) + CASE WHEN u THEN 34 ELSE 0 END) AS BIGINT) AS qwen2_vl,
  CAST(sum(length(x) + CASE WHEN u THEN 9 ELSE 0 END) AS BIGINT) AS mllama, CAST(sum(length(x)) AS BIGINT) AS paligemma FROM w GROUP BY conv_id"""
    )


MM_PLUGINS = _plugins_sql()


def st_events_by_window(spark, sf_dir):
    """The events as a stream: counts by hour and kind, once all of it has been read."""
    from uuid import uuid4

    from loomspark.functions.lineage import remove_at_end, shared_folder
    from loomspark.streaming.streams import events_by_window, keep_latest

    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = remove_at_end(spark, f"{shared_folder(spark)}/events-{uuid4().hex}")
    keep_latest(events_by_window(stream), f"{folder}/table", f"{folder}/checkpoint", seconds=None).awaitTermination()
    return spark.read.parquet(f"{folder}/table").select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "event_type", long(F.col("n"), "n"), F.round("total", 3).alias("total"))


ST_EVENTS_BY_WINDOW = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2"


QUERIES = (
    "smp_num_samples smp_num_samples_over smp_max_samples smp_page smp_train_order smp_fewshot mix_concat mix_interleave_under mix_interleave_over mix_interleave_probs "
    "spl_fraction spl_count agg_len_hist agg_len_cdf agg_lr agg_tps top_argmax_choice agg_tok_acc agg_rm_acc agg_ppl_seq agg_category_acc agg_avg_meter win_ema win_eta "
    "lim_page_log jn_pred_label win_throughput win_sample_5 win_last_token flt_log_loss agg_mfu ls_preference ls_rewards ls_batch_logps ls_ppo_trim snk_predictions_rm snk_predictions_batch mm_resize "
    "mm_token_counts mm_frame_idx mm_placeholders ev_format api_normalise api_usage api_stream api_resp_len fmt_think_html ex_gpa tool_formats agg_rouge_bleu agg_rouge_bleu_parts agg_rouge_segmented "
    "src_builder_belle src_builder_hh flt_catalog_ranking agg_kto_log agg_dpo_log mm_plugins st_events_by_window"
).split()


def queries() -> dict:
    return {name: globals()[name] for name in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
