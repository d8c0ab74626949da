"""Chat logs rebuilt from events and rendered with a reversible template (DataFrame code only).

An event log has one row an event: conversation, sequence number, kind, message id, role and
text. The kinds are

* ``message``: the whole text of a message (also what a null kind means);
* ``delta``: more text of a streamed message;
* ``edit``: a new text in place of everything so far;
* ``regenerate``: everything so far is dropped, later deltas build the new answer.

Events are partitioned by conversation, once; inside, those of a message are sorted by sequence
and folded: the text is that of the last event that is no delta and of all deltas behind it. A
message stands where its first event stood. Messages are rendered one by one, and put in order
by conversation.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside a text are
escaped (backslash doubled, ``<|`` as ``<\\|``) and roles are percent-encoded, so a parse
gives back every text exactly. The loss mask marks assistant texts by turn and offset.

Defined cases: null text is empty, null role is empty, null conversation is a conversation
of its own, equal sequence numbers are ordered by role and text, repeated rows are kept as
often as they occur, other columns play no part, an empty table gives no rows. A conversation becomes one string, which
Spark limits to 2 GB: that is what the result itself asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.llm.common import read_table

TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"\\([\\|])", "$1")).otherwise(text)


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, pos, role, text) of events (conv_id, seq, kind, message_id, role, text)."""
    log = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("kind", F.lit("message")).alias("kind"), "role", "text")))
    # Everything below goes by conversation or finer, so this is the only exchange.
    folded = events.repartition("conv_id").groupBy("conv_id", "message_id").agg(log.alias("log"))
    restarts = F.filter(F.transform("log", lambda e, i: F.when(e["kind"] != "delta", i)), lambda i: i.isNotNull())
    folded = folded.withColumn("from", F.coalesce(F.array_max(restarts), F.lit(0)))
    live = F.slice("log", F.col("from") + 1, F.size("log"))
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    return folded.select(
        "conv_id",
        F.col("log")[0]["seq"].alias("pos"),
        F.coalesce(F.try_element_at(roles, F.lit(1)), F.lit("")).alias("role"),
        F.array_join(F.transform(live, lambda e: F.coalesce(e["text"], F.lit(""))), "").alias("text"),
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row a conversation: its formatted string, turns and loss mask.

    ``loss_mask`` holds, for every text to learn from, its turn, its offset inside the turn's
    string, its ``start`` in the whole string and its length, in code points.
    """
    head = F.concat(F.lit(TURN_START), F.url_encode("role"), F.lit("\n"))
    rows = messages.select("conv_id", "pos", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"))
    rows = rows.withColumn("turn_text", F.concat("head", "body", F.lit(TURN_END + "\n"))).withColumn("size", F.length("turn_text").cast("long"))
    # Ties go by the text itself: escaping changes the order of texts with control strings.
    order = Window.partitionBy("conv_id").orderBy("pos", "role", "text")
    rows = rows.select(
        "conv_id",
        (F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("begin"),
        "turn_text",
        (F.col("role") == loss_role).alias("learn"),
        F.length("head").alias("at"),
        F.length("body").alias("length"),
    )
    turns = F.array_sort(F.collect_list(F.struct("begin", "turn_text", "learn", "at", "length")))
    grouped = rows.groupBy("conv_id").agg(turns.alias("turns"))
    spans = F.transform("turns", lambda t, i: F.struct(t["learn"].alias("learn"), i.alias("turn"), t["at"].alias("at"), (t["begin"] + t["at"]).alias("start"), t["length"].alias("length")))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["turn_text"]), "").alias("formatted"),
        F.size("turns").cast("long").alias("n_turns"),
        F.transform(F.filter(spans, lambda s: s["learn"]), lambda s: F.struct(s["turn"].alias("turn"), s["at"].alias("at"), s["start"].alias("start"), s["length"].alias("length"))).alias("loss_mask"),
    )


def split_turns(formatted: Column) -> Column:
    """The strings of a formatted conversation's turns, without the start marker."""
    return F.slice(F.split(formatted, r"<\|im_start\|>", -1), 2, F.greatest(F.size(F.split(formatted, r"<\|im_start\|>", -1)) - 1, F.lit(0)))


def parse(rendered: DataFrame) -> DataFrame:
    """Add ``parsed`` (role, text of each turn) and ``loss_texts``, read back from the output."""
    rows = rendered.withColumn("turn_strings", split_turns(F.col("formatted")))
    end = len(TURN_END) + 1

    def turn(t: Column) -> Column:
        role = F.substring_index(t, "\n", 1)
        body = F.substring(t, F.length(role) + 2, F.length(t) - F.length(role) - 1 - end)
        return F.struct(F.url_decode(role).alias("role"), unescape(body).alias("text"))

    def learned(s: Column) -> Column:
        return unescape(F.substring(F.element_at("turn_strings", s["turn"] + 1), s["at"] + 1 - len(TURN_START), s["length"]))

    return rows.withColumn("parsed", F.transform("turn_strings", turn)).withColumn("loss_texts", F.transform("loss_mask", learned))


def streamed(turns: DataFrame) -> DataFrame:
    """A log of how the given turns (conv_id, turn, role, text) may have come about.

    Answers are drafted, regenerated and streamed in two parts; questions are corrected by an
    edit; other turns, and those without a number, are written at once.
    """
    text = F.coalesce("text", F.lit(""))
    cut = F.ceil(F.length(text) / 3).cast("int")
    event = lambda step, kind, said: F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), said.cast("string").alias("text"))
    draft = F.lit("<|im_end|> a draft")
    answer = F.array(
        event(0, "message", draft), event(1, "delta", draft), event(2, "regenerate", F.lit(None)), event(3, "delta", F.substring(text, F.lit(1), cut)), event(4, "delta", F.substring(text, cut + 1, F.length(text)))
    )
    question = F.array(event(0, "message", draft), event(1, "edit", text))
    numbered = F.col("turn").isNotNull()
    events = F.when(numbered & (F.col("role") == "assistant"), answer).when(numbered & (F.col("role") == "user"), question).otherwise(F.array(event(0, "message", text)))
    # Numbered before the events are taken apart.
    rows = turns.withColumn("message_id", F.monotonically_increasing_id()).withColumn("__events", events)
    rows = rows.select("conv_id", "turn", "role", "message_id", F.explode("__events").alias("e"))
    return rows.select("conv_id", F.try_add(F.try_multiply(F.col("turn").cast("long"), F.lit(8)), F.col("e.step")).alias("seq"), "e.kind", "message_id", "role", "e.text")


def op7_event_sourced_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    saying = f"{TURN_END}{TURN_START}assistant ok"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(saying).alias("text"))
    log = streamed(table.unionByName(probe))
    back = parse(render(fold_events(log)))
    said = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: conversations has one row a turn, ordered by turn, role and text as the operator orders.
OP7_SQL = r"""
WITH log AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id,
  CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + 24 + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS BIGINT) AS formatted_chars
FROM log GROUP BY conv_id
"""
