"""Stage processors: token ids, attention masks and labels of canonical rows.

Truncation over turns is a fold over the turn pairs' lengths inside one expression, so a stage
is a single projection. Only tool descriptions and function messages go through Python first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import BOS_ID, EOS_ID, IGNORE, MEDIA_ID, bound, char_ids
from loomspark.operators.align import MESSAGES, message, valid_for
from loomspark.operators.multimodal import AUDIO, IMAGE, VIDEO, checked, process_messages
from loomspark.operators.templates import Template, encoded, id_target, one_turn, special_ids, turn_pairs, with_calls
from loomspark.operators.tools import TOOLS_DATE, tools_text
from loomspark.operators.vision import PROCESSORS, item_tokens

Encoder = Callable[[Column], Column]
INTS = "array<int>"
PAIRS = "array<struct<source:array<int>,target:array<int>>>"
MARKS = {"image": IMAGE, "video": VIDEO, "audio": AUDIO}


def infer_seqlen(source: Column, target: Column, cutoff: Column) -> tuple[Column, Column]:
    """How much of source and target fits a budget: the shorter one is kept whole if it is
    less than half of the budget, else both shrink in proportion."""
    share = (cutoff * (target / F.nullif(source + target, F.lit(0)))).cast("int")
    most = F.when(target * 2 < cutoff, cutoff).when(source * 2 < cutoff, cutoff - source).otherwise(F.coalesce(share, F.lit(0)))
    kept_target = F.least(most, target)
    return F.least(F.greatest(cutoff - kept_target, F.lit(0)), source), kept_target


def head(ids: Column, n: Column) -> Column:
    return F.slice(ids, F.lit(1), F.greatest(n, F.lit(0)))


def ignored(n: Column) -> Column:
    return F.array_repeat(F.lit(IGNORE), F.greatest(n, F.lit(0)).cast("int"))


def ones(ids: Column) -> Column:
    return F.array_repeat(F.lit(1), F.size(ids))


def ready(df: DataFrame, template: Template, date: str | None) -> DataFrame:
    """Rows whose tools, function messages and media marks are text that can be encoded.

    Adds ``__tools`` (the rendered tools) and ``__front`` (ids in front of the first message, for
    formats whose image tokens stand there), and rewrites the message columns. ``date`` None says
    that rows hold neither tools nor function messages, so that no Python runs. Marks are
    expanded over prompt and responses together, in the order of their media, where a column
    ``_image_tokens`` (``_video_tokens``, ``_audio_tokens``) gives each item's number of tokens, or
    its text for the plugins that write their own, or where ``_image_sizes`` and so on hold what
    the headers of the files say (``sources.media.with_sizes``). Media that a format takes none of are an error.
    """
    if date is None:
        rows = df.withColumn("__tools", F.lit(""))
    else:
        rows = with_calls(df.withColumn("__tools", tools_text(F.col("_tools"), template.tool_format, date)), ["_prompt", "_response"], template.tool_format)
    return with_media(rows, template)


def with_media(rows: DataFrame, template: Template) -> DataFrame:
    """Media marks of prompt and responses as the plugin of the template writes them."""
    tokens = dict(template.mm_tokens)
    sizes = {k: F.col(f"_{k}_tokens") for k in MARKS if f"_{k}_tokens" in rows.columns}
    for kind in MARKS:
        if kind in tokens and kind not in sizes and f"_{kind}_sizes" in rows.columns and template.mm_plugin in PROCESSORS:
            # Made once a row; the plugin reads them at every mark.
            made = item_tokens(template.mm_plugin, kind, tokens[kind], F.col(f"_{kind}_sizes"))
            rows = rows.withColumn(f"__{kind}_tokens", bound(made, lambda x: x))
            sizes[kind] = F.col(f"__{kind}_tokens")
    held = {k: F.greatest(F.coalesce(F.size(f"_{k}s"), F.lit(0)), F.lit(0)) for k in MARKS if f"_{k}s" in rows.columns}
    refused = F.lit(False)
    for kind, n in held.items():
        if kind not in tokens:
            refused = refused | (n > 0)
    front = F.array().cast(INTS)
    if tokens:
        several = F.lit(False)
        if template.mm_plugin == "minicpm_v":
            several = (held.get("image", F.lit(0)) > 0) & (held.get("video", F.lit(0)) > 0)
        both = F.concat("_prompt", F.coalesce(F.col("_response"), F.array().cast(MESSAGES)))
        counted = both
        for kind, mark in MARKS.items():
            if kind in tokens:
                counted = checked(counted, rows[f"_{kind}s"], mark)
        counted = F.when(several, F.raise_error(F.lit("This model takes either images or videos."))).otherwise(counted)
        made = bound(process_messages(template.mm_plugin, tokens, counted, sizes), lambda x: x)
        rows = rows.withColumn("__both", made)
        many = F.size("_prompt")
        rows = rows.withColumns({"_prompt": F.slice("__both", F.lit(1), many), "_response": F.slice("__both", many + 1, F.greatest(F.size("__both") - many, F.lit(0)))}).drop("__both")
        if template.mm_plugin == "paligemma" and "image" in sizes:
            total = F.aggregate(F.coalesce(sizes["image"], F.array().cast(INTS)), F.lit(0), lambda a, x: a + x)
            front = F.array_repeat(F.lit(special_ids(template).get(tokens["image"], MEDIA_ID)), total)
    error = F.raise_error(F.lit("This model takes no input of such a kind."))
    return rows.withColumn("__front", F.when(refused, error.cast(INTS)).otherwise(front))


def pieces(messages: Column, template: Template, encode: Encoder) -> Column:
    return encoded(messages, template, id_target(template, encode), F.col("_system"), F.col("__tools"))


def kept_lengths(pairs: Column, cutoff: int, used: Column) -> Column:
    """How many ids of source and target each pair keeps, until the budget is used up."""
    start = F.struct(used.cast("int").alias("total"), F.array().cast("array<struct<s:int,t:int>>").alias("kept"))

    def step(state: Column, pair: Column) -> Column:
        s, t = infer_seqlen(F.size(pair["source"]), F.size(pair["target"]), F.lit(cutoff) - state["total"])
        moved = bound(F.struct(s.cast("int").alias("s"), t.cast("int").alias("t")), lambda n: F.struct((state["total"] + n["s"] + n["t"]).cast("int").alias("total"), F.concat(state["kept"], F.array(n)).alias("kept")))
        return F.when(state["total"] >= cutoff, state).otherwise(moved)

    return F.aggregate(pairs, start, step, lambda state: state["kept"])


def fold_turns(pairs: Column, cutoff: int, efficient_eos: bool, train_on_prompt: bool, mask_history: bool, front: Column | None = None) -> Column:
    """(ids, labels) of the turns that fit; with ``mask_history`` the last turn comes first.

    Only lengths are folded over the turns; each kept id is then copied once.
    """
    none = F.array().cast(INTS)
    front = none if front is None else front

    def fitting(ids: Column, n: Column) -> Column:
        return F.when(F.size(ids) > n, F.slice(ids, F.lit(1), n)).otherwise(ids)

    def source_labels(source: Column, n: Column) -> Column:
        if train_on_prompt:
            return fitting(source, n)
        if efficient_eos:
            return F.when(n > 0, F.concat(F.array(F.lit(EOS_ID)), ignored(n - 1))).otherwise(none)
        return ignored(n)

    def target_labels(target: Column, n: Column, i: Column) -> Column:
        return F.when(i == 0, fitting(target, n)).otherwise(ignored(n)) if mask_history else fitting(target, n)

    def joined(turns: Column, kept: Column) -> Column:
        turns = head(turns, F.size(kept))
        ids = F.transform(turns, lambda p, i: F.array(fitting(p["source"], kept[i]["s"]), fitting(p["target"], kept[i]["t"])))
        labels = F.transform(turns, lambda p, i: F.array(source_labels(p["source"], kept[i]["s"]), target_labels(p["target"], kept[i]["t"], i)))
        flat = lambda first, parts: F.flatten(F.concat(F.array(first), F.flatten(F.reverse(parts) if mask_history else parts)))
        return F.struct(flat(front, ids).alias("ids"), flat(ignored(F.size(front)), labels).alias("labels"))

    used = F.size(front) + int(efficient_eos)
    return bound(F.reverse(pairs) if mask_history else pairs, lambda turns: bound(kept_lengths(turns, cutoff, used), lambda kept: joined(turns, kept)))


def media_columns() -> list[Column]:
    return [F.col(f"_{k}").alias(k) for k in ("images", "videos", "audios")]


def process_sft(
    df: DataFrame,
    template: Template,
    cutoff: int,
    keep: list[str] | None = None,
    encode: Encoder = char_ids,
    train_on_prompt: bool = False,
    mask_history: bool = False,
    tools_date: str | None = TOOLS_DATE,
) -> DataFrame:
    """Supervised tuning: ids, mask of ones, labels that leave the prompt out."""
    if train_on_prompt and mask_history:
        raise ValueError("Training on the prompt and masking the history exclude each other.")
    rows = ready(df.where(valid_for("sft")), template, tools_date)
    turns = bound(pieces(F.concat("_prompt", "_response"), template, encode), lambda made: F.coalesce(turn_pairs(made), F.array().cast(PAIRS)))
    rows = rows.withColumn("__fold", fold_turns(turns, cutoff, template.efficient_eos, train_on_prompt, mask_history, F.col("__front")))
    ids, labels = (F.concat(F.col(f"__fold.{c}"), F.array(F.lit(EOS_ID))) if template.efficient_eos else F.col(f"__fold.{c}") for c in ("ids", "labels"))
    return rows.select(*(keep or []), ids.alias("input_ids"), ones(ids).alias("attention_mask"), labels.alias("labels"), *media_columns())


def process_pretrain(df: DataFrame, cutoff: int, keep: list[str] | None = None, encode: Encoder = char_ids, add_bos: bool = False, end_id: int = EOS_ID) -> DataFrame:
    """Plain text and its end token, cut to the budget."""
    rows = df.where(valid_for("pt"))
    start = F.array(F.lit(BOS_ID)) if add_bos else F.array().cast(INTS)
    ids = head(F.concat(start, encode(F.col("_prompt")[0]["content"]), F.array(F.lit(end_id))), F.lit(cutoff))
    return rows.select(*(keep or []), ids.alias("input_ids"), ones(ids).alias("attention_mask"))


def pack_pretrain(rows: DataFrame, block: int, batch: str, order: str, ids: str = "input_ids", add_bos: bool = False) -> DataFrame:
    """Blocks of ``block`` ids of a batch's concatenated rows; the remainder is dropped.

    A running count of ids gives each row its place; rows are cut at the blocks' borders and
    meet by block, so no task holds the ids of a whole batch in one value.
    """
    before = Window.partitionBy(batch).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    size = F.size(ids).cast("long")
    placed = rows.select(batch, F.col(order).alias("__order"), F.col(ids).alias("__ids"), (F.sum(size).over(before) - size).alias("__at"), F.sum(size).over(Window.partitionBy(batch)).alias("__all")).where(F.size("__ids") > 0)
    first, last = F.floor(F.col("__at") / block), F.floor((F.col("__at") + F.size("__ids") - 1) / block)
    cut = placed.withColumn("block", F.explode(F.sequence(first, last)))
    low = F.greatest(F.lit(0).cast("long"), F.col("block") * block - F.col("__at"))
    high = F.least(F.size("__ids").cast("long"), (F.col("block") + 1) * block - F.col("__at"))
    whole = cut.where(F.col("block") < F.floor(F.col("__all") / block))
    whole = whole.select(batch, F.col("block").cast("int").alias("block"), "__at", F.slice("__ids", (low + 1).cast("int"), (high - low).cast("int")).alias("__ids"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("__at", "__ids"))), lambda x: x["__ids"])
    out = whole.groupBy(batch, "block").agg(F.flatten(parts).alias("input_ids"))
    if add_bos:
        out = out.withColumn("input_ids", F.concat(F.array(F.lit(BOS_ID)), F.slice("input_ids", F.lit(2), F.lit(block - 1))))
    return out


def answer_pieces(response: Column, template: Template, encode: Encoder) -> Column:
    """Ids of the prompt (``prompt``) and of one response (``answer``)."""
    made = pieces(F.concat(F.col("_prompt"), F.array(response)), template, encode)

    def apart(parts: Column) -> Column:
        prompt, answer = one_turn(parts)
        return F.struct(F.concat(F.col("__front"), F.flatten(prompt)).alias("prompt"), answer.alias("answer"))

    return bound(made, apart)


def process_pairwise(df: DataFrame, template: Template, cutoff: int, keep: list[str] | None = None, encode: Encoder = char_ids, tools_date: str | None = TOOLS_DATE) -> DataFrame:
    """Chosen and rejected answers of one prompt, under a common budget for the prompt."""
    rows = ready(df.where(valid_for("rm")), template, tools_date)
    rows = rows.withColumns({"__first": answer_pieces(F.col("_response")[0], template, encode), "__second": answer_pieces(F.col("_response")[1], template, encode)})
    prompt, chosen, rejected = F.col("__first.prompt"), F.col("__first.answer"), F.col("__second.answer")
    end = F.array(F.lit(EOS_ID)) if template.efficient_eos else F.array().cast(INTS)
    rows = rows.withColumns({"__p": prompt, "__c": F.concat(chosen, end), "__r": F.concat(rejected, end)})
    source, target = infer_seqlen(F.size("__p"), F.greatest(F.size("__c"), F.size("__r")), F.lit(cutoff))
    rows = rows.withColumns({"__p": head(F.col("__p"), source), "__c": head(F.col("__c"), target), "__r": head(F.col("__r"), target)})
    out = []
    for side, name in (("__c", "chosen"), ("__r", "rejected")):
        ids = F.concat("__p", side)
        out += [ids.alias(f"{name}_input_ids"), ones(ids).alias(f"{name}_attention_mask"), F.concat(ignored(F.size("__p")), F.col(side)).alias(f"{name}_labels")]
    return rows.select(*(keep or []), *out, *media_columns())


def kl_partners(df: DataFrame, order: str, batch_size: int) -> DataFrame:
    """Add ``__kl``: the response list of the row at the mirrored place of its batch.

    Batches are consecutive rows; all rows take part, valid or not.
    """
    rows = df.withColumn("__batch", F.floor(F.col(order) / batch_size))
    place = Window.partitionBy("__batch").orderBy(order)
    rows = rows.withColumn("__pos", F.row_number().over(place)).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("__batch")))
    other = rows.select("__batch", (F.col("__n") + 1 - F.col("__pos")).alias("__pos"), F.col("_response").alias("__kl"))
    return rows.join(other, ["__batch", "__pos"]).drop("__batch", "__pos", "__n")


def process_kto(df: DataFrame, template: Template, cutoff: int, order: str, keep: list[str] | None = None, encode: Encoder = char_ids, batch_size: int = 1000, tools_date: str | None = TOOLS_DATE) -> DataFrame:
    """Rated answers, and for each the mismatched answer of its mirrored batch partner."""
    rows = kl_partners(ready(df, template, tools_date), order, batch_size).where(valid_for("kto"))
    rows = rows.withColumn("__tag", F.length(F.col("_response")[0]["content"]) > 0)
    answer = F.when(F.col("__tag"), F.col("_response")[0]).otherwise(F.col("_response")[1])
    first = F.try_element_at(F.col("__kl"), F.lit(1))
    partner = F.coalesce(F.when(F.length(first["content"]) > 0, first).otherwise(F.try_element_at(F.col("__kl"), F.lit(2))), first, message("assistant", F.lit("")))
    end = F.array(F.lit(EOS_ID)) if template.efficient_eos else F.array().cast(INTS)
    rows = rows.withColumns({"__own": answer_pieces(answer, template, encode), "__other": answer_pieces(partner, template, encode)})
    rows = rows.withColumns({"__p": F.col("__own.prompt"), "__a": F.concat(F.col("__own.answer"), end), "__q": F.col("__other.prompt"), "__k": F.concat(F.col("__other.answer"), end)})
    out = []
    for source, target, name in (("__p", "__a", ""), ("__q", "__k", "kl_")):
        n, m = infer_seqlen(F.size(source), F.size(target), F.lit(cutoff))
        kept = head(F.col(target), m)
        ids = F.concat(head(F.col(source), n), kept)
        out += [ids.alias(f"{name}input_ids"), ones(ids).alias(f"{name}attention_mask"), F.concat(ignored(F.least(n, F.size(source))), kept).alias(f"{name}labels")]
    return rows.select(*(keep or []), *out, F.col("__tag").alias("kto_tags"), *media_columns())


def preference_balance(rows: DataFrame, batch: str) -> DataFrame:
    """Liked and other rows of each batch, and whether one kind is missing."""
    counts = rows.groupBy(batch).agg(F.count_if("kto_tags").alias("liked"), F.count_if(~F.col("kto_tags")).alias("other"))
    return counts.withColumn("one_sided", (F.col("liked") == 0) | (F.col("other") == 0))


def first_example(rows: DataFrame, decode: Callable[[Column], Column]) -> str:
    """The first row's ids and labels with their texts, for a look at the data."""
    row = rows.select("input_ids", decode(F.col("input_ids")).alias("inputs"), "labels", decode(F.filter("labels", lambda x: x != IGNORE)).alias("targets")).first()
    return "no rows" if row is None else "\n".join(f"{name}: {row[name]}" for name in row.asDict())


def process_unsupervised(df: DataFrame, template: Template, cutoff: int, keep: list[str] | None = None, encode: Encoder = char_ids, tools_date: str | None = TOOLS_DATE) -> DataFrame:
    """Prompt ids as input and the response (or an empty one) as labels."""
    rows = ready(df.where(valid_for("ppo")), template, tools_date)
    answer = F.when(F.size("_response") == 1, F.col("_response")[0]).otherwise(message("assistant", F.lit("")))
    rows = rows.withColumn("__own", answer_pieces(answer, template, encode))
    end = F.array(F.lit(EOS_ID)) if template.efficient_eos else F.array().cast(INTS)
    rows = rows.withColumns({"__p": F.col("__own.prompt"), "__a": F.concat(F.col("__own.answer"), end)})
    source, target = infer_seqlen(F.size("__p"), F.size("__a"), F.lit(cutoff))
    ids = head(F.col("__p"), source)
    return rows.select(*(keep or []), ids.alias("input_ids"), ones(ids).alias("attention_mask"), head(F.col("__a"), target).alias("labels"), *media_columns())
