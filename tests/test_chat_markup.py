"""Compiled chat templates against texts worked out by hand, and slots read from them."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from loomspark.operators.chat_markup import compile_template
from loomspark.operators.templates import TEMPLATES, ChatTokenizer, encoded, jinja_template, read_tokenizer, resolve_template, text_target

CHAT = [("system", " s "), ("user", "u1"), ("assistant", "<think>x</think> a1 "), ("user", "u2")]
MESSAGES = "m array<struct<role:string,content:string>>"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(CHAT,), (CHAT[1:],), ([],)], MESSAGES)


def render(rows, source, **given):
    return [r["t"] for r in rows.select(compile_template(source, **given)(F.col("m")).alias("t")).collect()]


CASES = [
    ("a{# no #}b\n{% if true %}\nx\n{% endif %}\ny", ["ab\nx\ny"] * 3),
    ("  {%- if false -%} x {% else %} y {%- endif %} z", [" y z"] * 3),
    ("{% for m in messages %}{{ loop.index }}{{ m.role[0:1] }}{% if not loop.last %},{% endif %}{% endfor %}", ["1s,2u,3a,4u", "1u,2a,3u", ""]),
    ("{% for m in messages if m['role'] == 'user' %}<{{ m['content'] | upper }}>{% endfor %}", ["<U1><U2>"] * 2 + [""]),
    ("{% if messages[0].role == 'system' %}{% set s = messages[0].content | trim %}{% endif %}{% if s is defined %}[{{ s }}]{% else %}-{% endif %}", ["[s]", "-", "-"]),
    ("{% set ns = namespace(n=0, last='') %}{% for m in messages %}{% if m.role == 'user' %}{% set ns.n = ns.n + 1 %}{% set ns.last = m.content %}{% endif %}{{ ns.n }}{% endfor %}={{ ns.last }}", ["0112=u2", "112=u2", "="]),
    ("{{ messages | length }}{{ messages[-1].content if messages | length > 3 else 'few' }}", ["4u2", "3few", "0few"]),
    ("{% for m in messages[1:] %}{{ m.content.split('</think>')[-1].strip() ~ '/' }}{% endfor %}", ["u1/a1/u2/", "a1/u2/", ""]),
    ("{{ bos_token }}{% if tools %}T{% endif %}{% if add_generation_prompt %}>{% endif %}{{ eos_token is defined }}", ["<s>>False"] * 3),
    ("{% for m in messages %}{{ (loop.index0 // 2) * 2 % 3 }}{% endfor %}{{ 'it\\'s\\n' + \"q\" }}", ["0022it's\nq", "002it's\nq", "it's\nq"]),
    ("{% if 'u' in messages[0].content and not messages[0].content.startswith('s') or false %}y{% else %}n{% endif %}", ["n", "y", "n"]),
    ("{% set x = none %}{% if x is none and y is not defined and x != 'a' %}ok{% endif %}{{ x | default('d') }}", ["okd"] * 3),
]


@pytest.mark.parametrize("source,want", CASES)
def test_templates_render_as_worked_out(rows, source, want):
    assert render(rows, source, bos="<s>", add_generation_prompt=True) == want


def test_what_is_not_taken_is_an_error(rows):
    for source in ("{% macro x() %}", "{% if a %}", "{% endfor %}", "{{ messages | tojson }}", "{{ 'a' | nope }}", "{% for x in 'abc' %}{% endfor %}", "{{ 1 + }}", "{{ 'a' is weird }}", "{{ @ }}", "{{ messages }}", "{% set a.b = 1 %}"):
        with pytest.raises(ValueError):
            render(rows, source)
    refuses = "{% for m in messages %}{% if m.role == 'system' %}{{ raise_exception('no system') }}{% endif %}{% endfor %}"
    with pytest.raises(Exception, match="no system"):
        render(rows, refuses)
    assert render(rows.where("size(m) = 3"), refuses) == [""]


def test_written_templates_come_back(rows):
    system = F.when(F.col("m")[0]["role"] == "system", F.col("m")[0]["content"]).otherwise("")
    said = F.filter("m", lambda x: x["role"] != "system")
    columns = {}
    for name, template in TEMPLATES.items():
        try:
            source = jinja_template(template, "<s>", "</s>")
        except ValueError:
            continue
        if any("{{idx}}" in str(s) for s in template.user):
            continue
        want = F.array_join(encoded(said, template, text_target("<s>", "</s>"), system, F.lit("")), "")
        columns[name] = F.struct(want.alias("want"), compile_template(source, "<s>", "</s>")(F.col("m")).alias("got"))
    assert len(columns) > 60
    names = sorted(columns)
    for at in range(0, len(names), 16):
        for r in rows.where("size(m) > 0").select(*(columns[n].alias(n) for n in names[at : at + 16])).collect():
            assert all(r[n]["want"] == r[n]["got"] for n in names[at : at + 16]), [n for n in names[at : at + 16] if r[n]["want"] != r[n]["got"]]


LLAMA3 = (
    "{% set loop_messages = messages %}{% for message in loop_messages %}{% set content = '<|start_header_id|>' + message['role'] + '<|end_header_id|>\n\n'+ message['content'] | trim + '<|eot_id|>' %}"
    "{% if loop.index0 == 0 %}{% set content = bos_token + content %}{% endif %}{{ content }}{% endfor %}{% if add_generation_prompt %}{{ '<|start_header_id|>assistant<|end_header_id|>\n\n' }}{% endif %}"
)
QWEN = (
    "{% for message in messages %}{% if loop.first and messages[0]['role'] != 'system' %}{{ '<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n' }}{% endif %}"
    "{{'<|im_start|>' + message['role'] + '\n' + message['content'] + '<|im_end|>' + '\n'}}{% endfor %}{% if add_generation_prompt %}{{ '<|im_start|>assistant\n' }}{% endif %}"
)


def test_slots_are_read_from_a_tokenizer(spark, tmp_path):
    (tmp_path / "tokenizer_config.json").write_text(json.dumps({"chat_template": LLAMA3, "bos_token": {"content": "<|begin_of_text|>"}, "eos_token": "<|eot_id|>"}))
    own = resolve_template(None, tokenizer=read_tokenizer(spark, str(tmp_path / "tokenizer_config.json")))
    assert own.user == ("<|start_header_id|>user<|end_header_id|>\n\n{{content}}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n",)
    assert own.assistant == ("{{content}}<|eot_id|>",) and own.prefix == ("<|begin_of_text|>",) and own.default_system == ""
    assert own.system == ("<|start_header_id|>system<|end_header_id|>\n\n{{content}}<|eot_id|>",)
    qwen = resolve_template(None, tokenizer=ChatTokenizer(QWEN, eos="<|im_end|>"))
    assert qwen.user == ("<|im_start|>user\n{{content}}<|im_end|>\n<|im_start|>assistant\n",) and qwen.prefix == ()
    assert qwen.assistant == ("{{content}}<|im_end|>\n",) and qwen.system == ("<|im_start|>system\n{{content}}<|im_end|>\n",) and qwen.default_system == "You are a helpful assistant."
    assert resolve_template(None, tokenizer=ChatTokenizer()) is TEMPLATES["empty"]
