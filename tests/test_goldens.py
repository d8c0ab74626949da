"""Literal results of alignment, templates, tools, processors, packing and metrics."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from loomspark.functions.text import BOS_ID, EOS_ID, IGNORE, PAD_ID, char_ids, replace_first, strip, word_ids
from loomspark.operators import collate, metrics, mixing, multimodal, preference, serving, stages, templates, tools
from loomspark.operators.align import align, register_aligner, valid_for
from loomspark.operators.templates import TEMPLATES, encoded, id_target, jinja_template, model_file, parse_template, register_template, resolve_template, text_target, turn_pairs
from loomspark.sources.catalog import DatasetSpec, check_stage, dataset_specs, spec_of

CHAT = "messages array<struct<role:string,content:string>>, _system string, _tools string"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


# Registry.
def test_naming_columns_unsets_the_others():
    spec = spec_of("x", {"file_name": "x.json", "columns": {"prompt": "text"}})
    assert (spec.prompt, spec.query, spec.response, spec.messages) == ("text", None, None, None) and spec.user_tag == "human"
    tagged = spec_of("y", {"hf_hub_url": "a/b", "formatting": "sharegpt", "tags": {"role_tag": "role", "user_tag": "user"}})
    assert tagged.system_tag is None and tagged.load_from == "huggingface" and tagged.messages == "conversations"


def test_sources_have_a_precedence():
    entry = {"ms_hub_url": "m", "hf_hub_url": "h", "script_url": "s", "file_name": "f"}
    assert spec_of("x", entry).name == "h" and spec_of("x", entry, "modelscope").load_from == "modelscope"
    assert spec_of("x", {"script_url": "s", "file_name": "f"}).load_from == "script"
    with pytest.raises(ValueError):
        dataset_specs(["nope"], {})
    assert dataset_specs(["a/b"], "ONLINE")[0].load_from == "huggingface"
    with pytest.raises(ValueError):
        check_stage(DatasetSpec("x"), "rm")


# Alignment.
ALPACA = "instruction string, input string, output string, system string, history array<array<string>>, chosen string, rejected string, liked boolean, pic array<string>"


def alpaca(spark, spec, *values):
    df = spark.createDataFrame([values], ALPACA)
    return align(df, spec).first().asDict(recursive=True)


def test_alpaca_rows(spark):
    row = alpaca(spark, DatasetSpec("x"), "Solve the math problem.", "3 + 4", "The answer is 7.", None, None, None, None, None, None)
    assert row["_prompt"] == [{"role": "user", "content": "Solve the math problem.\n3 + 4"}]
    assert row["_response"] == [{"role": "assistant", "content": "The answer is 7."}]
    assert (row["_system"], row["_tools"], row["_images"]) == ("", "", None)
    spec = DatasetSpec("x", history="history", system="system", images="pic")
    row = alpaca(spark, spec, "q", "", None, "sys", [["a", "b"]], None, None, None, ["1.png"])
    assert [m["role"] for m in row["_prompt"]] == ["user", "assistant", "user"] and row["_prompt"][2]["content"] == "q"
    assert row["_response"] == [] and row["_system"] == "sys" and row["_images"] == ["1.png"]
    assert alpaca(spark, DatasetSpec("x"), None, None, "", None, None, None, None, None, None)["_prompt"] == [{"role": "user", "content": ""}]


def test_alpaca_ratings_and_pairs(spark):
    spec = DatasetSpec("x", kto_tag="liked", ranking=True, chosen="chosen", rejected="rejected")
    texts = lambda row: [m["content"] for m in row["_response"]]
    assert texts(alpaca(spark, spec, "q", None, "r", None, None, "c", "d", True, None)) == ["r", ""]
    assert texts(alpaca(spark, spec, "q", None, "r", None, None, "c", "d", False, None)) == ["", "r"]
    assert texts(alpaca(spark, spec, "q", None, "r", None, None, "c", "d", None, None)) == ["c", "d"]
    assert texts(alpaca(spark, spec, "q", None, "r", None, None, None, "d", None, None)) == ["r"]


def sharegpt(spark, turns, **more):
    spec = DatasetSpec("x", formatting="sharegpt", **more)
    df = spark.createDataFrame([(turns, ("gpt", "c"), ("gpt", "d"))], "conversations array<struct<from:string,value:string>>, chosen struct<from:string,value:string>, rejected struct<from:string,value:string>")
    return align(df, spec).first().asDict(recursive=True)


def test_sharegpt_rows(spark):
    row = sharegpt(spark, [("system", "be nice"), ("human", "hi"), ("gpt", "hello")])
    assert row["_system"] == "be nice" and row["_prompt"] == [{"role": "user", "content": "hi"}] and row["_response"] == [{"role": "assistant", "content": "hello"}]
    for broken in ([("human", "hi")], [("gpt", "x"), ("human", "y")], [("human", "a"), ("human", "b")], [("human", "a"), ("alien", "b")]):
        row = sharegpt(spark, broken)
        assert row["_prompt"] == [] and row["_response"] == []
    assert sharegpt(spark, [])["_prompt"] == [] and sharegpt(spark, [("system", "only")])["_system"] == "only"
    row = sharegpt(spark, [("human", "hi")], ranking=True, chosen="chosen", rejected="rejected")
    assert [m["content"] for m in row["_response"]] == ["c", "d"] and len(row["_prompt"]) == 1
    assert sharegpt(spark, [("human", "a"), ("function_call", "f"), ("observation", "o"), ("gpt", "b")])["_prompt"][1]["role"] == "function"


def test_own_aligners(spark):
    register_aligner("lines", lambda df, spec, keep, media: df.select(F.lit(1).alias("x")))
    assert align(spark.range(1), DatasetSpec("x", formatting="lines")).first()["x"] == 1
    with pytest.raises(ValueError):
        register_aligner("lines", None)
    register_aligner("pages", lambda df, spec, keep: df.select(*keep, F.array(F.lit("a.png")).alias("_images"), *(F.lit(None).cast("array<string>").alias(k) for k in ("_videos", "_audios"))))
    listing = spark.createDataFrame([("a.png", "/media/a.png")], "name string, path string")
    assert align(spark.range(1), DatasetSpec("x", formatting="pages"), keep=["id"], media_files=listing).first()["_images"] == ["/media/a.png"]


# Templates.
TURNS = [("user", "How are you"), ("assistant", "I am fine!"), ("user", "你好"), ("assistant", "很高兴认识你！")]


def rendered(spark, name, turns=TURNS, system="", tools="", ids=False):
    df = spark.createDataFrame([(turns, system, tools)], CHAT)
    target = id_target(TEMPLATES[name]) if ids else text_target("<s>", "</s>")
    return df.select(encoded(F.col("messages"), TEMPLATES[name], target, F.col("_system"), F.col("_tools")).alias("p")).first()["p"]


def test_template_texts(spark):
    head = "<|start_header_id|>{}<|end_header_id|>\n\n{}<|eot_id|>"
    ask = lambda t: head.format("user", t) + "<|start_header_id|>assistant<|end_header_id|>\n\n"
    assert rendered(spark, "llama3") == ["<s>" + ask("How are you"), "I am fine!<|eot_id|>", ask("你好"), "很高兴认识你！<|eot_id|>"]
    assert rendered(spark, "llama3", system="s")[0] == "<s>" + head.format("system", "s") + ask("How are you")
    assert rendered(spark, "qwen")[0].startswith("<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n<|im_start|>user\nHow are you<|im_end|>")
    assert rendered(spark, "llama2", system="s")[0] == "<s>[INST] <<SYS>>\ns\n<</SYS>>\n\nHow are you [/INST]" and rendered(spark, "llama2", system="s")[2] == "<s>[INST] 你好 [/INST]"
    assert rendered(spark, "chatglm2")[2] == "[Round 1]\n\n问：你好\n\n答："
    assert rendered(spark, "gemma")[1] == "I am fine!<end_of_turn>\n" and rendered(spark, "phi4")[0] == "<|im_start|>user<|im_sep|>How are you<|im_end|><|im_start|>assistant<|im_sep|>"
    assert rendered(spark, "mistral", tools="[T]")[0] == "<s>[INST] [T]\n\nHow are you[/INST]"
    assert rendered(spark, "default", [("user", "at {{idx}} and {{idx}}"), ("assistant", "{{content}}")]) == ["Human: at 0 and {{idx}}\nAssistant:", "{{content}}</s>\n"]


def test_every_template_renders(spark):
    for name in TEMPLATES:
        text, ids = rendered(spark, name), rendered(spark, name, ids=True)
        assert len(text) == 4 and all("How are you" in text[0] for _ in [0]) and len(ids) == 4
    assert len(TEMPLATES) == 80


def test_unknown_roles_are_errors(spark):
    with pytest.raises(Exception, match="Unexpected role"):
        rendered(spark, "chatml", [("alien", "x")])


def test_template_registry():
    register_template("own", user=["<u>{{content}}<m>"], prefix=["<s>"])
    assert resolve_template("own").assistant[0] == "{{content}}"
    with pytest.raises(ValueError):
        register_template("own")
    with pytest.raises(ValueError):
        register_template("bad", user=["no placeholder"])
    with pytest.raises(ValueError):
        resolve_template("nope")
    with pytest.raises(ValueError):
        resolve_template("glm4", train_on_prompt=True)
    assert resolve_template(None).name == "empty" and resolve_template("qwen", "llama3").tool_format == "llama3"


def test_template_texts_for_other_tools():
    jinja = jinja_template(TEMPLATES["qwen"])
    assert "{% set system_message = 'You are a helpful assistant.' %}" in jinja and "'<|im_start|>user\n' + content + '<|im_end|>" in jinja
    assert "loop.index0 == 0" in jinja_template(TEMPLATES["llama2"])
    file = model_file(TEMPLATES["llama3"], "<|begin|>", "<|eot_id|>")
    assert 'PARAMETER stop "<|eot_id|>"' in file and "{{ .Content }}" in file and "PARAMETER num_ctx 4096" in file
    with pytest.raises(ValueError):
        jinja_template(TEMPLATES["chatglm3"])


def test_parsing_a_known_format():
    def render(messages, ask):
        out = "" if messages[0]["role"] == "system" else "[sys]nice[/sys]"
        for m in messages:
            out += f"[{m['role'][:3]}]{m['content']}[/{m['role'][:3]}]"
        return out + "[ass]" * ask

    parsed = parse_template("p", render)
    assert parsed.default_system == "nice" and parsed.user == ("[use]{{content}}[/use][ass]",) and parsed.system == ("[sys]{{content}}[/sys]",)


# Tools.
TOOLS = [{"name": "test_tool", "description": "tool_desc", "parameters": {"type": "object", "properties": {"foo": {"type": "string", "description": "foo_desc"}, "bar": {"type": "number", "description": "bar_desc"}}, "required": ["foo"]}}]
CALL = {"name": "tool_name", "arguments": {"foo": "bar", "size": 10}}


def test_tool_descriptions():
    text = json.dumps(TOOLS)
    assert tools.describe_tools(text, "default", "") == (
        "You have access to the following tools:\n> Tool Name: test_tool\nTool Description: tool_desc\nTool Args:\n"
        "  - foo (string, required): foo_desc\n  - bar (number): bar_desc\n\nUse the following format if using a tool:\n```\n"
        "Action: tool name (one of [test_tool])\nAction Input: the input to the tool, in a JSON format representing the kwargs "
        '(e.g. ```{"input": "hello world", "num_beams": 5}```)\n```\n'
    )
    assert tools.describe_tools(text, "mistral", "") == "[AVAILABLE_TOOLS] " + json.dumps([{"type": "function", "function": TOOLS[0]}]) + "[/AVAILABLE_TOOLS]"
    assert "Today Date: 01 Jan 2025\n" in tools.describe_tools(text, "llama3", "01 Jan 2025")
    assert tools.describe_tools("[]", "qwen", "") == ""
    with pytest.raises(RuntimeError):
        tools.describe_tools("{", "qwen", "")


@pytest.mark.parametrize(
    ("name", "single", "double"),
    [
        ("default", 'Action: tool_name\nAction Input: {"foo": "bar", "size": 10}\n', True),
        ("glm4", 'tool_name\n{"foo": "bar", "size": 10}', False),
        ("llama3", '{"name": "tool_name", "parameters": {"foo": "bar", "size": 10}}', False),
        ("mistral", '[{"name": "tool_name", "arguments": {"foo": "bar", "size": 10}}]', True),
        ("qwen", '<tool_call>\n{"name": "tool_name", "arguments": {"foo": "bar", "size": 10}}\n</tool_call>', True),
    ],
)
def test_tool_calls(spark, name, single, double):
    assert tools.render_calls(json.dumps(CALL), name) == single
    found = spark.createDataFrame([(single,), ("plain text",), (None,)], "t string").select(tools.extract_calls(F.col("t"), name).alias("c")).collect()
    assert [tuple(c) for c in found[0]["c"]] == [("tool_name", '{"foo": "bar", "size": 10}')] and found[1]["c"] is None and found[2]["c"] is None
    if double:
        both = tools.render_calls(json.dumps([CALL, CALL]), name)
        assert len(tools.tool_format(name).extract(both)) == 2
    else:
        with pytest.raises(ValueError):
            tools.render_calls(json.dumps([CALL, CALL]), name)
    assert tools.render_calls("<think>hm</think>" + json.dumps(CALL), name) == "hm" + single


def test_function_messages(spark):
    turns = [("user", "q"), ("function", json.dumps(CALL)), ("observation", "r"), ("assistant", "a")]
    df = templates.with_calls(spark.createDataFrame([(turns, "", "")], CHAT), ["messages"], "qwen")
    out = df.select(encoded(F.col("messages"), TEMPLATES["qwen"], text_target(), F.col("_system"), F.lit("")).alias("p")).first()["p"]
    assert out[1].startswith("<tool_call>\n") and "<tool_response>\nr\n</tool_response>" in out[2]


# Processors.
@pytest.mark.parametrize(("lengths", "want"), [((3000, 2000, 1000), (600, 400)), ((2000, 3000, 1000), (400, 600)), ((1000, 100, 1000), (900, 100)), ((100, 1000, 1000), (100, 900)), ((100, 500, 1000), (100, 500)), ((500, 100, 1000), (500, 100)), ((10, 10, 1000), (10, 10)), ((0, 0, 10), (0, 0))])
def test_infer_seqlen(spark, lengths, want):
    assert tuple(one(spark, *stages.infer_seqlen(*(F.lit(n) for n in lengths)))) == want


def chat_rows(spark, *rows):
    schema = "rid long, _prompt array<struct<role:string,content:string>>, _response array<struct<role:string,content:string>>, _system string, _tools string, _images array<string>, _videos array<string>, _audios array<string>"
    return spark.createDataFrame([(i, p, r, "", "", None, None, None) for i, (p, r) in enumerate(rows)], schema)


def ords(text):
    return [ord(c) for c in text]


def test_sft_labels(spark):
    rows = chat_rows(spark, ([("user", "ab"), ("assistant", "cd"), ("user", "ef")], [("assistant", "gh")]), ([], []))
    empty = TEMPLATES["default"]
    out = stages.process_sft(rows, empty, 1000, keep=["rid"]).collect()
    assert len(out) == 1
    ask1, ask2, end = ords("Human: ab\nAssistant:"), ords("Human: ef\nAssistant:"), [EOS_ID, 10]
    ids = [*ask1, *ords("cd"), *end, *ask2, *ords("gh"), *end]
    assert out[0]["input_ids"] == ids and out[0]["attention_mask"] == [1] * len(ids)
    assert out[0]["labels"] == [IGNORE] * 20 + ords("cd") + end + [IGNORE] * 20 + ords("gh") + end
    assert stages.process_sft(rows, empty, 1000, train_on_prompt=True).first()["labels"] == ids
    masked = stages.process_sft(rows, empty, 1000, mask_history=True).first()
    assert masked["input_ids"] == ids and masked["labels"] == [IGNORE] * 44 + ords("gh") + end
    short = stages.process_sft(rows, empty, 30).first()["input_ids"]
    assert len(short) == 30 and short[:24] == ids[:24]
    eos = stages.process_sft(rows, TEMPLATES["breeze"], 1000).first()
    assert eos["input_ids"][-1] == EOS_ID and eos["labels"][0] == EOS_ID and len(eos["labels"]) == len(eos["input_ids"]) and eos["input_ids"][0] == BOS_ID


def test_pairs_and_ratings(spark):
    rows = chat_rows(spark, ([("user", "ab")], [("assistant", "cd"), ("assistant", "e")]), ([("user", "x")], [("assistant", ""), ("assistant", "yz")]), ([], []))
    out = stages.process_pairwise(rows, TEMPLATES["empty"], 100, keep=["rid"]).orderBy("rid").collect()
    assert out[0]["chosen_input_ids"] == ords("abcd") and out[0]["rejected_labels"] == [IGNORE, IGNORE, ord("e")] and len(out) == 2
    kto = {r["rid"]: r for r in stages.process_kto(rows, TEMPLATES["empty"], 100, "rid", keep=["rid"], batch_size=3).collect()}
    assert kto[0]["kto_tags"] and not kto[1]["kto_tags"] and kto[1]["input_ids"] == ords("xyz")
    # Rows 0 and 2 of the batch are partners; row 2 has no answer; row 1 is its own.
    assert kto[0]["kl_input_ids"] == ords("ab") and kto[1]["kl_input_ids"] == ords("xyz")


def test_unsupervised_and_pretraining(spark):
    rows = chat_rows(spark, ([("user", "ab")], [("assistant", "cd")]), ([("user", "ef")], []))
    out = stages.process_unsupervised(rows, TEMPLATES["empty"], 100, keep=["rid"]).orderBy("rid").collect()
    assert [(r["input_ids"], r["labels"]) for r in out] == [(ords("ab"), ords("cd")), (ords("ef"), [])]
    plain = stages.process_pretrain(rows, 3, keep=["rid"], add_bos=True).orderBy("rid").collect()
    assert plain[0]["input_ids"] == [BOS_ID, *ords("ab")]
    packed = stages.pack_pretrain(stages.process_pretrain(rows, 99, ["rid"]).withColumn("b", F.lit(0)), 4, "b", "rid", add_bos=True).collect()
    assert [r["input_ids"] for r in packed] == [[BOS_ID, ord("b"), EOS_ID, ord("e")]]


# Packing and padding.
def test_knapsack_keeps_everything_that_fits():
    assert collate.knapsack([5, 5, 3, 2, 9, 20], 10) == [[9], [5, 5], [3, 2]]
    rng = random.Random(1)
    for _ in range(200):
        lengths = [rng.randint(0, 30) for _ in range(rng.randint(0, 40))]
        bins = collate.knapsack(lengths, 25)
        assert sorted(n for b in bins for n in b) == sorted(n for n in lengths if n <= 25) and all(sum(b) <= 25 for b in bins)


def test_packed_blocks(spark):
    rows = spark.createDataFrame([(0, i, [i] * n, [i] * n) for i, n in enumerate([3, 3, 2, 9])], "b int, rid int, input_ids array<int>, labels array<int>")
    out = collate.pack_sft(rows, 6, "b", "rid", neat=True, pad_id=0).orderBy("block").collect()
    # Of equal lengths the last comes first.
    assert [r["input_ids"] for r in out] == [[1, 1, 1, 0, 0, 0, 0], [2, 2, 0, 0, 0, 0, 0]] and out[0]["attention_mask"] == [1, 1, 1, 2, 2, 2, 0]
    assert out[1]["labels"] == [2, 2] + [IGNORE] * 5
    assert collate.pack_sft(rows, 6, "b", "rid").first()["attention_mask"] == [1] * 7


def test_segments(spark):
    rows = spark.createDataFrame([(0, [1, 1, 2, 2, 2, 0]), (1, [1, 2, 2, 3, 3, 3]), (2, [0, 0])], "rid int, attention_mask array<int>")
    lengths = [r["n"] for r in rows.orderBy("rid").select(collate.segment_lengths(F.col("attention_mask")).alias("n")).collect()]
    assert lengths == [[2, 3], [1, 2, 3], []]
    cu = [(r["cu_start"], r["cu_end"]) for r in collate.unpadded(rows, "rid").orderBy("cu_start").collect()]
    assert cu == [(0, 2), (2, 5), (5, 6), (6, 8), (8, 11)]
    assert rows.where("rid = 0").select(collate.flat_indices(F.col("attention_mask")).alias("i")).first()["i"] == [0, 1, 2, 3, 4]
    dense = rows.where("rid = 0").select(collate.dense_mask(F.col("attention_mask"), -1.0).alias("m")).first()["m"]
    assert ["".join("o" if x == 0 else "x" for x in r) for r in dense] == ["oxxxxx", "ooxxxx", "xxoxxx", "xxooxx", "xxooox", "xxxxxx"]
    assert collate.mask_pairs(rows, "rid").where("rid = 0").count() == 9


def test_padding(spark):
    rows = spark.createDataFrame([(0, 0, list(range(6)), [1] * 6, list(range(6))), (0, 1, [6, 7], [1, 1], [6, 7])], "b int, rid int, input_ids array<int>, attention_mask array<int>, labels array<int>")
    out = collate.pad_batches(rows, "b").orderBy("rid").collect()
    assert out[1]["input_ids"] == [6, 7] + [PAD_ID] * 6 and out[1]["labels"] == [6, 7] + [IGNORE] * 6 and out[0]["attention_mask"] == [1] * 6 + [0, 0]
    assert collate.pad_batches(rows, "b", 4, left=True).orderBy("rid").collect()[1]["attention_mask"] == [0] * 6 + [1, 1]


# Metrics.
def test_scores(spark):
    acc = metrics.token_accuracy(F.array(*(F.lit(x) for x in (1, 2, 3))), F.array(*(F.lit(x) for x in (IGNORE, 1, 9))))
    assert one(spark, acc)[0] == 0.5
    assert one(spark, F.isnan(metrics.token_accuracy(F.array(F.lit(1), F.lit(2)), F.array(F.lit(IGNORE), F.lit(IGNORE)))))[0]
    assert metrics.rouge_n("a b c".split(), "a b d".split(), 1) == pytest.approx(2 / 3) and metrics.rouge_l("a b c d".split(), "a c d b".split()) == pytest.approx(0.75)
    assert metrics.bleu4("abcdef", "abcdef") == pytest.approx(1.0) and metrics.bleu4("", "a") == 0.0 and 0 < metrics.bleu4("ab", "abcd") < 1
    s = one(spark, metrics.similarity_scores(F.lit("a b c"), F.lit("a b c")).alias("s"))["s"]
    assert s["rouge_1"] == s["rouge_l"] == 100.0


def test_smoothing(spark):
    import math

    xs = [1.0, 2.0, 4.0, 3.0]
    w = 1.8 * (1 / (1 + math.exp(-0.05 * len(xs))) - 0.5)
    want, last = [], xs[0]
    for x in xs:
        last = last * w + (1 - w) * x
        want.append(last)
    assert one(spark, metrics.smoothed(F.array(*(F.lit(x) for x in xs))))[0] == pytest.approx(want)
    assert one(spark, metrics.smoothed(F.array().cast("array<double>")))[0] == []
    assert one(spark, metrics.clock(F.lit(100000.0)))[0] == "1 day, 3:46:40" and one(spark, metrics.clock(F.lit(59.9)))[0] == "0:00:59"


def test_preference_trimming(spark):
    ids = lambda *xs: F.array(*(F.lit(x) for x in xs))
    assert one(spark, preference.trim_left(ids(0, 0, 5, 0, 6), 0))[0] == [5, 0, 6]
    assert one(spark, preference.trim_right(ids(5, 6, 0, 0), 0, 9))[0] == [5, 6] and one(spark, preference.trim_right(ids(5, 6, 0, 0), 0, 0))[0] == [5, 6, 0]
    assert one(spark, preference.trim_right(ids(0, 0), 0, 9))[0] == [0]


# Mixing.
def test_mixing_orders(spark):
    a, b = (spark.range(n).select(F.col("id").alias("rid"), F.concat(F.lit(x), F.col("id").cast("string")).alias("v")) for x, n in (("a", 4), ("b", 2)))
    order = lambda df: [r["v"] for r in df.orderBy("mix_pos").collect()]
    assert order(mixing.mix([a, b])) == ["a0", "a1", "a2", "a3", "b0", "b1"]
    assert order(mixing.mix([a, b], "interleave_under")) == ["a0", "b0", "a1", "b1"]
    assert order(mixing.mix([a, b], "interleave_over")) == ["a0", "b0", "a1", "b1", "a2", "b0", "a3", "b1"]
    chance = order(mixing.mix([a, b], "interleave_over", [0.7, 0.3]))
    assert set(chance) == {"a0", "a1", "a2", "a3", "b0", "b1"}
    assert order(mixing.mix([a], "nonsense")) == ["a0", "a1", "a2", "a3"]
    for bad in (("other", None), ("concat", [1.0, 0.0]), ("interleave_under", [1.0])):
        with pytest.raises(ValueError):
            mixing.mix([a, b], *bad)


def test_samples_and_splits(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    assert mixing.sample_rows(df, 30, "k").distinct().count() == 30
    more = mixing.sample_rows(df, 150, "k")
    assert more.count() == 150 and more.select("k").distinct().count() == 100
    assert mixing.sample_rows(df.limit(0), 5, "k").count() == 0
    for size, n in ((0.125, 13), (7, 7), (1, 100)):
        parts = mixing.split(df, size, "k")
        assert parts["validation"].count() == n and parts["train"].count() == 100 - n and parts["train"].join(parts["validation"], "k").count() == 0
    assert list(mixing.split(df, 0.0, "k")) == ["train"]
    numbered = mixing.number_rows(df, [F.col("k").desc()], parts=7).collect()
    assert sorted((r["rid"], r["k"]) for r in numbered) == [(i, 99 - i) for i in range(100)]


# Media and serving.
def test_media(spark):
    assert tuple(one(spark, *multimodal.resized(F.lit(2000), F.lit(1000)))) == (1086, 543) and tuple(one(spark, *multimodal.resized(F.lit(16), F.lit(16)))) == (32, 32)
    assert one(spark, multimodal.row_tokens(F.lit(32), F.lit(32), 16, "[IMG]", "[IMG_BREAK]", "[IMG_END]"))[0] == "[IMG][IMG][IMG_BREAK][IMG][IMG][IMG_END]"
    assert one(spark, multimodal.grid_tokens(F.lit(1), F.lit(4), F.lit(4)))[0] == 4
    df = spark.createDataFrame([([("user", "<image>a<image>"), ("assistant", "b<image>")], ["x"])], "messages array<struct<role:string,content:string>>, images array<string>")
    counts = F.array(F.lit(1), F.lit(2), F.lit(3))
    out = df.select(multimodal.expand_counted(F.col("messages"), "<image>", "#", counts).alias("m")).first()["m"]
    assert [m["content"] for m in out] == ["#a##", "b###"]
    with pytest.raises(Exception, match="number of"):
        df.select(multimodal.checked(F.col("messages"), F.col("images"), "<image>")).collect()
    ids, labels, types = one(spark, *multimodal.prefixed(F.array(F.lit(1)), F.array(F.lit(2)), 7, F.lit(2)))
    assert (ids, labels, types) == ([7, 7, 1], [IGNORE, IGNORE, 2], [0, 0, 1])
    assert one(spark, multimodal.frame_indices(F.lit(10), F.lit(2.0)))[0] == [0, 3, 6, 9] and len(one(spark, multimodal.frame_indices(F.lit(0), F.lit(0.0)))[0]) == 128


def test_requests(spark):
    body = json.dumps({"model": "m", "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": json.dumps([{"type": "text", "text": "see"}, {"type": "image_url", "image_url": {"url": "u"}}])}, {"role": "assistant", "tool_calls": [{"id": "1", "type": "function", "function": {"name": "f", "arguments": "{}"}}]}, {"role": "tool", "content": "r"}]})
    df = spark.createDataFrame([(body,)], "b string").select(serving.parse_requests(F.col("b")).alias("request"))
    row = serving.normalise(df).first()
    assert row["valid"] and row["system"] == "s" and row["images"] == ["u"]
    assert [(m["role"], m["content"]) for m in row["messages"]] == [("user", "see<image>"), ("function", '[{"name": "f", "arguments": {}}]'), ("observation", "r")]
    assert tuple(one(spark, *serving.response_length(F.array(F.lit(5), F.lit(2), F.lit(7)), 2))) == (2, "stop")
    assert one(spark, serving.image_bytes(F.lit("data:image/png;base64,QUI=")))[0] == b"AB"
    assert one(spark, serving.valid_tools(F.lit('[{"name": "x"}]')), serving.valid_tools(F.lit('[{"nom": "x"}]')))[:] == (True, False)
    with pytest.raises(ValueError):
        serving.check_stream(True, 1)


def test_text_functions(spark):
    assert one(spark, strip(F.lit("　 a b\t\n")))[0] == "a b" and one(spark, replace_first(F.lit("a-b-c"), "-", F.lit("+")))[0] == "a+b-c"
    assert one(spark, char_ids(F.lit("aé😀")))[0] == [97, 233, 128512] and one(spark, char_ids(F.lit("")))[0] == []
    assert len(one(spark, word_ids(F.lit(" a  b ")))[0]) == 2
    assert one(spark, turn_pairs(F.array().cast("array<array<int>>")))[0] is None and valid_for("pt") is not None


def test_special_tokens():
    fixed = templates.fixed_tokens(templates.SpecialTokens(eos="</s>"), TEMPLATES["chatml"])
    assert (fixed.eos, fixed.pad, fixed.additional) == ("<|im_end|>", "<|im_end|>", ("<|im_start|>",))
    assert templates.fixed_tokens(templates.SpecialTokens(pad="<p>"), TEMPLATES["default"]) == templates.SpecialTokens(None, "<|endoftext|>", "<p>")
    assert EOS_ID in templates.stop_ids(TEMPLATES["llama3"]) and len(templates.stop_ids(TEMPLATES["llama3"])) == 3


def test_answers_and_scores(spark):
    rows = spark.createDataFrame([(1, "plain", "stop"), (1, '<tool_call>\n{"name": "f", "arguments": {}}\n</tool_call>', "stop")], "id long, text string, reason string")
    out = {r["finish_reason"]: r for r in serving.responses(rows, "qwen").collect()}
    assert out["stop"]["content"] == "plain" and out["tool_calls"]["content"] is None and out["tool_calls"]["tool_calls"][0]["name"] == "f"
    assert sorted(r["score"] for r in serving.scored(rows, "text", lambda texts: [len(t) for t in texts]).collect())[0] == 5.0


def test_first_example_and_balance(spark):
    from loomspark.sources.sinks import char_text

    rows = chat_rows(spark, ([("user", "ab")], [("assistant", "cd")]))
    shown = stages.first_example(stages.process_sft(rows, TEMPLATES["empty"], 100), char_text)
    assert "inputs: abcd" in shown and "targets: cd" in shown and stages.first_example(stages.process_sft(rows.limit(0), TEMPLATES["empty"], 100), char_text) == "no rows"
    tags = spark.createDataFrame([(0, True), (0, False), (1, True)], "b int, kto_tags boolean")
    assert {r["b"]: r["one_sided"] for r in stages.preference_balance(tags, "b").collect()} == {0: False, 1: True}


# Tools, calls and media inside stages.
def stage_rows(spark, turns, answer, tools="", images=None, tokens=None):
    schema = "_prompt array<struct<role:string,content:string>>, _response array<struct<role:string,content:string>>, _system string, _tools string, _images array<string>, _videos array<string>, _audios array<string>, _image_tokens array<int>"
    return spark.createDataFrame([(turns, answer, "", tools, images, None, None, tokens)], schema)


def said(ids):
    return "".join(chr(i) for i in ids if 0 <= i < 0x110000)


def test_stages_hold_tools_and_calls(spark):
    turns = [("user", "q"), ("function", json.dumps(CALL)), ("observation", "r")]
    rows = stage_rows(spark, turns, [("assistant", "a"), ("function", json.dumps(CALL))], json.dumps(TOOLS))
    template = TEMPLATES["qwen"]
    call = '<tool_call>\n{"name": "tool_name", "arguments": {"foo": "bar", "size": 10}}\n</tool_call>'
    answered = rows.withColumn("_response", F.slice("_response", 1, 1))
    sft = said(stages.process_sft(answered, template, 5000).first()["input_ids"])
    assert "# Tools" in sft and '"name": "test_tool"' in sft and call in sft and "<tool_response>\nr\n</tool_response>" in sft
    pair = stages.process_pairwise(rows, template, 5000).first()
    assert call in said(pair["rejected_labels"]) and "# Tools" in said(pair["chosen_input_ids"])
    kto = stages.process_kto(rows.withColumn("rid", F.lit(0)), template, 5000, "rid").first()
    assert "# Tools" in said(kto["kl_input_ids"]) and said(kto["labels"]).startswith("a")
    assert "# Tools" in said(stages.process_unsupervised(answered, template, 5000).first()["input_ids"])


def test_stages_hold_media(spark):
    rows = stage_rows(spark, [("user", "<image>what <image>?")], [("assistant", "a")], images=["x", "y"], tokens=[2, 3])
    one = stages.process_sft(rows, TEMPLATES["qwen2_vl"], 5000).first()
    text = said(one["input_ids"])
    assert "<|vision_start|>" + "<|image_pad|>" * 2 + "<|vision_end|>what <|vision_start|>" + "<|image_pad|>" * 3 in text and one["images"] == ["x", "y"]
    for name, wrong in (("qwen2_vl", ["x"]), ("qwen", ["x", "y"])):
        with pytest.raises(Exception, match="placeholders|no input"):
            stages.process_sft(rows.withColumn("_images", F.array(*map(F.lit, wrong))), TEMPLATES[name], 5000).collect()
    front = stages.process_sft(rows, TEMPLATES["paligemma"], 5000).first()
    assert front["input_ids"][:5] == [front["input_ids"][0]] * 5 and front["labels"][:5] == [IGNORE] * 5 and "<image>" not in said(front["input_ids"])
    both = rows.withColumns({"_videos": F.array(F.lit("v")), "_prompt": F.array(F.struct(F.lit("user").alias("role"), F.lit("<image><image><video>").alias("content")))})
    with pytest.raises(Exception, match="either images or videos"):
        stages.process_sft(both, TEMPLATES["minicpm_v"], 5000).collect()


def test_packing_keeps_long_rows_and_media(spark):
    schema = "rid long, b int, input_ids array<int>, labels array<int>, images array<string>"
    df = spark.createDataFrame([(i, 0, [i] * n, [i] * n, m) for i, (n, m) in enumerate([(5, ["p"]), (3, None), (8, ["q", "r"])])], schema)
    blocks = collate.pack_sft(df, 8, "b", "rid", neat=True).orderBy("block").collect()
    assert [(list(r["rows"]), r["images"]) for r in blocks] == [([2], ["q", "r"]), ([0, 1], ["p"])] and all(len(r["input_ids"]) == 9 for r in blocks)
    assert collate.too_long(df, 7, "b").first()["dropped"] == 1


def test_segments_out_of_order(spark):
    masks = [[1, 1, 2, 2, 2, 0], [2, 1, 2, 0], [0, 0], [], [3, 3, 1]]
    df = spark.createDataFrame([(m,) for m in masks], "m array<int>")
    assert [r[0] for r in df.select(collate.segment_lengths(F.col("m"))).collect()] == [[2, 3], [1, 2], [], [], [1, 2]]


def test_running_sums_by_group(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), i, rng.randint(0, 9)) for i in range(300)]
    out = mixing.running_sums(spark.createDataFrame(rows, "g string, i int, v int"), [F.col("i")], {"s": F.col("v"), "n": F.lit(1)}, ["g"], parts=7).collect()
    assert len(out) == 300
    for r in out:
        before = [v for g, i, v in rows if g == r["g"] and i <= r["i"]]
        assert (r["s"], r["n"]) == (sum(before), len(before))


def test_longest_common_subsequence_is_brute_force():
    rng = random.Random(9)
    for _ in range(300):
        a, b = (rng.choices("abcd", k=rng.randint(1, 30)) for _ in range(2))
        row = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                row[i + 1][j + 1] = row[i][j] + 1 if x == y else max(row[i][j + 1], row[i + 1][j])
        assert metrics.rouge_l(a, b) == pytest.approx(metrics.overlap_f(row[-1][-1], len(a), len(b)))
