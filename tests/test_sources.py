"""Readers, builders, sinks, preparation and streams on small files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from loomspark.operators import evaluation
from loomspark.operators.align import align
from loomspark.plans.prepare import DataOptions, get_dataset, unmerged
from loomspark.sources import builders, hubs, media, mirror, readers, sinks
from loomspark.sources.catalog import DatasetSpec, catalog_table, usable_datasets
from loomspark.streaming import streams


def test_files_of_every_type(spark, tmp_path):
    rows = [{"a": 1, "b": "x\ny"}, {"a": 2, "b": "é"}]
    (tmp_path / "list.json").write_text(json.dumps(rows))
    (tmp_path / "lines.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "table.csv").write_text('a,b\n1,"x\ny"\n2,é\n')
    (tmp_path / "text.txt").write_text("one\ntwo\n")
    for name in ("list.json", "lines.jsonl", "table.csv"):
        assert [(int(r["a"]), r["b"]) for r in readers.read_files(spark, str(tmp_path / name)).orderBy("a").collect()] == [(1, "x\ny"), (2, "é")]
    assert [r["text"] for r in readers.read_files(spark, str(tmp_path / "text.txt")).collect()] == ["one", "two"]
    import pyarrow as pa

    table = pa.table({"a": [1, 2], "b": ["x", "y"]})
    with pa.OSFile(str(tmp_path / "t.arrow"), "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        w.write_table(table)
    assert readers.read_files(spark, str(tmp_path / "t.arrow")).orderBy("a").collect()[1]["b"] == "y"
    with pytest.raises(ValueError, match="identical"):
        readers.read_files(spark, str(tmp_path))
    with pytest.raises(ValueError):
        readers.read_files(spark, str(tmp_path / "missing.json"))


def test_hubs_and_scripts(spark):
    with pytest.raises(RuntimeError):
        hubs.read_hub(spark, DatasetSpec("a/b", "huggingface"))
    hubs.register_script("mine", lambda s, folder: s.range(3))
    assert readers.read_dataset(spark, DatasetSpec("mine", "script")).count() == 3
    catalog = catalog_table(spark, {"x": {"file_name": "x", "ranking": True}, "y": {"file_name": "y"}})
    assert [r["dataset"] for r in usable_datasets(catalog, "dpo").collect()] == ["x"]


def test_transcripts(spark):
    df = spark.createDataFrame([("Human: Hi\nAssistant: Hello\nHuman: Bye \nAssistant:", " See you ")], "instruction string, output string")
    said = builders.build_transcripts(df).first()["conversations"]
    assert [tuple(s) for s in said] == [("human", "Hi"), ("gpt", "Hello"), ("human", "Bye"), ("gpt", "See you")]
    text = "\n\nHuman: Hi\n\nAssistant: Hello\n\nHuman: Bye\n\nAssistant: {}"
    df = spark.createDataFrame([(text.format("yes"), text.format("no"))], "chosen string, rejected string")
    row = builders.build_preferences(df).first()
    assert (row["instruction"], row["chosen"], row["rejected"], row["history"]) == ("Bye", "yes", "no", [["Hi", "Hello"]])
    lines = spark.createDataFrame([('{"id": "1", "data": ["a", "b", "c"]}',), ("not json",), ('{"id": "2", "data": ["a"]}',)], "value string")
    assert [(r["id"], len(r["conversations"])) for r in builders.parse_turn_lists(lines).collect()] == [("1", 2)]


def test_suites(spark, tmp_path):
    for folder, name, text in (("m", "law_test.csv", "q?,w,x,y,z,A\n"), ("c", "law_val.csv", "id,question,A,B,C,D,answer,explanation\n0,q?,w,x,y,z,,\n"), ("k", "law.csv", ",Question,A,B,C,D,Answer\n0,q?,w,x,y,z,B\n")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / name).write_text(text)
    assert readers.read_mmlu(spark, str(tmp_path / "m")).first().asDict() == dict(question="q?", A="w", B="x", C="y", D="z", answer="A", subject="law")
    assert readers.read_ceval(spark, str(tmp_path / "c")).first()["answer"] == "" and readers.read_cmmlu(spark, str(tmp_path / "k")).first()["answer"] == "B"
    (tmp_path / "mapping.json").write_text(json.dumps({"law": {"name": "Law", "category": "Humanities"}}))
    mapping = readers.read_mapping(spark, str(tmp_path / "mapping.json"))
    assert readers.with_category(readers.read_mmlu(spark, str(tmp_path / "m")), mapping).first()["category"] == "Humanities"


def test_prompt_goldens(spark):
    rows = [("1", "math", 0, "Fewshot example", "x", "y", "z", "w", "B"), ("1", "math", 9, "Target", "x", "y", "z", "w", "C")]
    df = spark.createDataFrame(rows, "item string, subject string, at int, question string, A string, B string, C string, D string, answer string")
    made = df.select("item", "subject", "at", evaluation.question_text({c: F.col(c) for c in ("question", "A", "B", "C", "D")}).alias("prompt"), "answer")
    messages = evaluation.prompts(made, ["item"], "at").first()["messages"]
    assert [(m["role"], m["content"]) for m in messages] == [
        ("user", "The following are multiple choice questions (with answers) about math.\n\nFewshot example\nA. x\nB. y\nC. z\nD. w\nAnswer:"),
        ("assistant", "B"),
        ("user", "Target\nA. x\nB. y\nC. z\nD. w\nAnswer:"),
        ("assistant", "C"),
    ]
    assert evaluation.task_of("mmlu_test") == ("mmlu", "test")


def test_logs(spark, tmp_path):
    records = [{"current_steps": i, "total_steps": 4, "loss": float(4 - i), "percentage": 25.0 * i} for i in range(1, 5)]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text("\n".join(map(json.dumps, records)))
    log = readers.read_trainer_log(spark, str(tmp_path / "log"))
    assert readers.with_loss(log).count() == 3 and readers.latest_record(log).first()["percentage"] == 100.0
    series = readers.loss_series(log).orderBy("step").collect()
    assert [r["loss"] for r in series] == [3.0, 2.0, 1.0] and series[0]["smoothed"] == 3.0
    query = streams.keep_latest(streams.monitor(spark, str(tmp_path / "log")), str(tmp_path / "state"), str(tmp_path / "seen"), seconds=None)
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "state")).first()["current_steps"] == 4
    (tmp_path / "state.json").write_text(json.dumps({"log_history": [{"loss": 1.0, "step": 1}, {"eval_loss": 2.0, "step": 2}]}))
    assert readers.with_loss(readers.read_trainer_state(spark, str(tmp_path / "state.json"))).count() == 1
    sinks.append_log(log.where("current_steps = 1"), str(tmp_path / "log"))
    assert readers.read_trainer_log(spark, str(tmp_path / "log")).count() == 5
    count, page = readers.preview(log, "current_steps", 1)
    assert count == 4 and [r["current_steps"] for r in page.collect()] == [3, 4]


@pytest.fixture
def folder(tmp_path):
    rows = [{"instruction": f"q{i}", "input": "", "output": f"a{i}"} for i in range(10)]
    (tmp_path / "one.json").write_text(json.dumps(rows))
    (tmp_path / "two.jsonl").write_text("\n".join(json.dumps({"instruction": f"r{i}", "input": "z", "output": "b"}) for i in range(4)))
    (tmp_path / "dataset_info.json").write_text(json.dumps({"one": {"file_name": "one.json"}, "two": {"file_name": "two.jsonl", "num_samples": 6}, "bad": {"file_name": "one.json", "columns": {"prompt": "instruction"}}}))
    return str(tmp_path)


def test_preparation(spark, folder, tmp_path):
    options = DataOptions(template="default", dataset=("one", "two"), dataset_dir=folder, cutoff_len=64, val_size=3)
    out = get_dataset(spark, options, "sft")
    assert out["train"].count() == 13 and out["validation"].count() == 3
    first = out["train"].unionByName(out["validation"]).orderBy("rid").first()
    assert first["input_ids"][:9] == [ord(c) for c in "Human: q0"]
    packed = get_dataset(spark, DataOptions(template="default", dataset=("one",), dataset_dir=folder, cutoff_len=64, packing=True, neat_packing=True), "sft")["train"]
    assert {len(r["input_ids"]) for r in packed.collect()} == {65} and packed.agg(F.sum("segments")).first()[0] == 10
    pretrain = get_dataset(spark, DataOptions(dataset=("one",), dataset_dir=folder, cutoff_len=8), "pt")["train"]
    assert [len(r["input_ids"]) for r in pretrain.collect()] == [8, 8, 8]
    limited = get_dataset(spark, DataOptions(dataset=("one",), dataset_dir=folder, max_samples=4), "sft")["train"]
    assert limited.count() == 4
    path = str(tmp_path / "tokens")
    saved = get_dataset(spark, DataOptions(dataset=("one",), dataset_dir=folder, val_size=0.2, tokenized_path=path), "sft")
    assert saved["validation"].count() == 2 and readers.has_tokenized(spark, path)
    again = get_dataset(spark, DataOptions(dataset=("nothing",), tokenized_path=path), "sft")
    assert again["train"].count() == 8
    with pytest.raises(Exception):
        sinks.write_tokenized(saved, path)
    assert list(unmerged(spark, DataOptions(eval_dataset=("one",), dataset_dir=folder), "sft")) == ["validation_one"]
    with pytest.raises(RuntimeError, match="no valid row"):
        get_dataset(spark, DataOptions(dataset=("bad",), dataset_dir=folder), "sft")
    assert get_dataset(spark, DataOptions(dataset=("bad",), dataset_dir=folder), "ppo")["train"].count() == 10


@pytest.mark.parametrize(
    ("options", "stage"),
    [
        (DataOptions(val_size=0.1), "sft"),
        (DataOptions(dataset=("a",), eval_dataset=("b",), val_size=0.1), "sft"),
        (DataOptions(dataset=("a",), interleave_probs=(0.5, 0.5), mix_strategy="interleave_under"), "sft"),
        (DataOptions(dataset=("a",), interleave_probs=(1.0,)), "sft"),
        (DataOptions(streaming=True, dataset=("a",), val_size=0.1), "sft"),
        (DataOptions(streaming=True, max_samples=3), "sft"),
        (DataOptions(mask_history=True, train_on_prompt=True), "sft"),
        (DataOptions(train_on_prompt=True), "rm"),
        (DataOptions(neat_packing=True), "pt"),
    ],
)
def test_options_that_exclude_each_other(options, stage):
    with pytest.raises(ValueError):
        options.validate(stage)


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"k": 10 * k + i}) for i in range(10)))
    source = lambda: streams.stream_files(spark, str(tmp_path / "in"), "k long", files_per_batch=1)
    seen: list[list[int]] = []
    streams.shuffled_batches(source(), "k", lambda df, n: seen.append([r["k"] for r in df.collect()]), str(tmp_path / "c1")).awaitTermination()
    assert sorted(x for b in seen for x in b) == list(range(30)) and len(seen) == 3 and seen[0] != sorted(seen[0])
    parts = streams.split_stream(source(), "k", 0.3)
    got = {}
    for name, part in parts.items():
        streams.append_stream(part, str(tmp_path / name), str(tmp_path / f"c-{name}")).awaitTermination()
        got[name] = {r["k"] for r in spark.read.schema("k long").json(str(tmp_path / name)).collect()}
    assert got["train"] | got["validation"] == set(range(30)) and not got["train"] & got["validation"]
    mixed = streams.mix_streams([source(), source()]).writeStream.format("memory").queryName("mixed").trigger(availableNow=True).start()
    mixed.awaitTermination()
    assert spark.table("mixed").count() == 60
    with pytest.raises(ValueError):
        streams.check_streaming(0, 0, None, None)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([([0, 0, 5, 6], [-100, 7])], "ids array<int>, labels array<int>")
    row = rows.select(sinks.pads_last(F.col("ids"), 0).alias("a"), sinks.without_ignored(F.col("labels")).alias("b"), sinks.without_ignored(F.col("labels"), 0).alias("c"), sinks.char_text(F.array(F.lit(104), F.lit(128512), F.lit(0x110001))).alias("d")).first()
    assert (row["a"], row["b"], row["c"], row["d"]) == ([5, 6, 0, 0], [7], [0, 7], "h😀")
    sinks.write_predictions(spark.createDataFrame([("p", None, "l")], "prompt string, predict string, label string"), str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).columns == ["label", "predict", "prompt"]
    assert sinks.command_settings({"a": None, "b": False, "c": "", "packing": False, "d": 1}) == {"packing": False, "d": 1}
    scores = spark.createDataFrame([(0.125, 2.675)], "chosen double, rejected double")
    assert tuple(sinks.pair_scores(scores).first()) == (0.12, 2.68)
    results = evaluation.results_by_subject(spark.createDataFrame([("law", 0, "A")], "subject string, i int, p string"), "subject", "i", "p")
    sinks.write_eval_results(results, "Average: 1", str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r/results.log")).first()[0] == "Average: 1"


def test_settings_and_models(tmp_path):
    from loomspark.sources.models import ModelCatalog
    from loomspark.sources.settings import read_settings

    (tmp_path / "a.yaml").write_text("# a run\nstage: sft\ncutoff_len: 1024  # tokens\nval_size: 0.1\npacking: true\nname: 'x y'\nempty:\n")
    assert read_settings(str(tmp_path / "a.yaml")) == {"stage": "sft", "cutoff_len": 1024, "val_size": 0.1, "packing": True, "name": "x y", "empty": None}
    (tmp_path / "a.json").write_text('{"a": 1}')
    assert read_settings(str(tmp_path / "a.json")) == {"a": 1} and read_settings(["--a", "1", "--b=x", "--c"]) == {"a": 1, "b": "x", "c": True}
    catalog = ModelCatalog()
    catalog.register_group({"M-7B": {"huggingface": "m/7b"}, "M-7B-Chat": {"huggingface": "m/7b-chat", "modelscope": "M/7b"}}, template="m")
    assert catalog.template("M-7B") == "default" and catalog.template("M-7B-Chat") == "m" and catalog.locate("M-7B-Chat", "modelscope") == "M/7b" and catalog.locate("other") == "other"


def test_streams_are_taken_and_interleaved(spark, tmp_path):
    for i in range(3):
        spark.range(10 * i, 10 * i + 10).withColumnRenamed("id", "k").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("k long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.take_and_skip(source(), "k", 14, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    taken, skipped = ([r["k"] for r in spark.read.parquet(str(tmp_path / "out" / part)).collect()] for part in ("validation", "train"))
    assert len(taken) == 14 and sorted(taken + skipped) == list(range(30))
    got = []
    other = source().select((F.col("k") + 100).alias("k"))
    streams.interleaved_batches([source(), other], "k", lambda df, n: got.append(df.orderBy("mix_pos").collect()), str(tmp_path / "c2")).awaitTermination()
    assert [r["k"] for batch in got for r in batch if r["ds_idx"] == 0] and all([r["ds_idx"] for r in batch] == [0, 1] * (len(batch) // 2) for batch in got)
    with pytest.raises(ValueError):
        streams.interleaved_batches([source(), other], "k", print, str(tmp_path / "c3"), probabilities=[1.0])


def test_media_paths(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"x")
    listing = readers.media_listing(spark, str(tmp_path))
    spec = DatasetSpec("m", formatting="alpaca", prompt="q", query=None, response="a", images="pics")
    df = spark.createDataFrame([(1, "<image>?", "yes", ["b.png", "a.png"]), (2, "no", "no", None), (3, "<image>", "x", ["a.png"])], "rid long, q string, a string, pics array<string>")
    out = {r["rid"]: r["_images"] for r in align(df, spec, keep=["rid"], media_files=listing).collect()}
    assert out[1][0] == "b.png" and out[1][1].endswith("/a.png") and out[1][1] != "a.png" and out[2] is None and len(out[3]) == 1


def test_nested_settings():
    from loomspark.sources.settings import read_yaml

    text = """# run
model: x  # name
dataset: [a, b]
args:
  rate: 1.0e-4
  tags:
    - one
    - "two # 2"
  deep: {}
list:
- k: 1
  v: yes it is
- plain
"""
    assert read_yaml(text) == {"model": "x", "dataset": ["a", "b"], "args": {"rate": 1.0e-4, "tags": ["one", "two # 2"], "deep": {}}, "list": [{"k": 1, "v": "yes it is"}, "plain"]}


def test_remote_registry():
    from loomspark.sources.catalog import dataset_specs

    hubs.register_files("testhub", lambda repository, file: json.dumps({"d": {"file_name": f"{repository}.json"}}))
    assert dataset_specs(["d"], "REMOTE:me/data", "testhub")[0].name == "me/data.json"
    with pytest.raises(ValueError):
        dataset_specs(["d"], "REMOTE:me/data", "huggingface")


def test_streamed_and_cached_preparation(spark, tmp_path):
    rows = [{"instruction": f"ask {i}", "output": f"answer {i}"} for i in range(6)]
    (tmp_path / "d.jsonl").write_text("\n".join(map(json.dumps, rows)))
    registry = {"d": {"file_name": "d.jsonl", "columns": {"prompt": "instruction", "response": "output"}}}
    options = DataOptions(template="default", dataset=("d",), dataset_dir=str(tmp_path), streaming=True)
    stream = get_dataset(spark, options, "sft", registry)["train"]
    assert stream.isStreaming
    stream.writeStream.format("memory").queryName("streamed").trigger(availableNow=True).start().awaitTermination()
    batch = DataOptions(template="default", dataset=("d",), dataset_dir=str(tmp_path), cache_path=str(tmp_path / "cache"))
    want = get_dataset(spark, batch, "sft", registry)["train"]
    ids = lambda df: sorted(tuple(r["input_ids"]) for r in df.collect())
    assert ids(spark.table("streamed")) == ids(want) and want.count() == 6
    assert ids(get_dataset(spark, batch, "sft", registry)["train"]) == ids(want) and len([f for f in (tmp_path / "cache").iterdir() if f.is_dir()]) == 1
    with pytest.raises(ValueError):
        get_dataset(spark, options, "kto", registry)


def test_packed_preparation_keeps_long_rows(spark, tmp_path):
    rows = [{"instruction": "short", "output": "x"}, {"instruction": "long", "output": "y" * 2000}]
    (tmp_path / "d.jsonl").write_text("\n".join(map(json.dumps, rows)))
    registry = {"d": {"file_name": "d.jsonl", "columns": {"prompt": "instruction", "response": "output"}}}
    options = DataOptions(template="default", dataset=("d",), dataset_dir=str(tmp_path), cutoff_len=512, packing=True)
    blocks = get_dataset(spark, options, "sft", registry)["train"].collect()
    assert sorted(i for r in blocks for i in r["rows"]) == [0, 1] and all(len(r["input_ids"]) == 513 for r in blocks)


def chunk(name, body):
    return len(body).to_bytes(4, "big") + name + body + bytes(4)


def mp4_box(name, *parts):
    body = b"".join(parts)
    return (8 + len(body)).to_bytes(4, "big") + name + body


MEDIA_FILES = {
    "a.png": (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", (640).to_bytes(4, "big") + (480).to_bytes(4, "big") + b"\x08\x02\0\0\0") + chunk(b"IDAT", b"x"), ("png", 640, 480, 1)),
    "b.jpg": (b"\xff\xd8\xff\xe1\0\x06EXIF\xff\xff\xc4\0\x03\0\xff\xc2\0\x11\x08\x01\x02\x03\x04\x03", ("jpeg", 0x304, 0x102, 1)),
    "c.jpg": (b"\xff\xd8\xff\xe0\0\x10JFIF", ("jpeg", None, None, None)),
    "d.gif": (b"GIF89a\x05\0\x06\0\x91\0\0" + bytes(12) + b"!\xff\x0bNETSCAPE2.0\x03\x01\0\0\0" + (b"!\xf9\x04\0\x14\0\0\0" + b",\0\0\0\0\x05\0\x06\0\x80" + bytes(6) + b"\x02\x02L\x01\0") * 3 + b";", ("gif", 5, 6, 3)),
    "e.webp": (b"RIFF\0\0\0\0WEBPVP8L\x05\0\0\0\x2f" + ((99) | (49 << 14)).to_bytes(4, "little") + b"\0", ("webp", 100, 50, 1)),
    "f.webp": (b"RIFF\0\0\0\0WEBPVP8 \x0a\0\0\0\0\0\0\x9d\x01\x2a\x40\x01\xf0\x00", ("webp", 320, 240, 1)),
    "g.bmp": (b"BM" + bytes(16) + (7).to_bytes(4, "little") + (-9).to_bytes(4, "little", signed=True), ("bmp", 7, 9, 1)),
    "h.wav": (b"RIFF\0\0\0\0WAVELIST\x03\0\0\0abc\0fmt \x10\0\0\0\x01\0\x02\0\x80\x3e\0\0\0\xfa\0\0\x04\0\x10\0data\xff\xff\xff\xff" + bytes(32000), ("wav", None, None, None)),
    "i.txt": (b"no medium", (None, None, None, None)),
    "k.mp4": (
        mp4_box(b"ftyp", b"isom") + (1).to_bytes(4, "big") + b"mdat" + (24).to_bytes(8, "big") + bytes(8)
        + mp4_box(b"moov", mp4_box(b"mvhd", b"\x01" + bytes(19), (600).to_bytes(4, "big"), (1500).to_bytes(8, "big")),
            mp4_box(b"trak", mp4_box(b"tkhd", bytes(76), bytes(8)), mp4_box(b"mdia", mp4_box(b"mdhd", bytes(12), (48000).to_bytes(4, "big"), (96000).to_bytes(4, "big")), mp4_box(b"hdlr", bytes(8), b"soun", bytes(12)))),
            mp4_box(b"trak", mp4_box(b"tkhd", bytes(76), (1920 << 16).to_bytes(4, "big"), (1080 << 16).to_bytes(4, "big")),
                mp4_box(b"mdia", mp4_box(b"mdhd", bytes(12), (25).to_bytes(4, "big"), (60).to_bytes(4, "big")), mp4_box(b"hdlr", bytes(8), b"vide", bytes(12)), mp4_box(b"minf", mp4_box(b"stbl", mp4_box(b"stsz", bytes(8), (60).to_bytes(4, "big"))))))),
        ("mp4", 1920, 1080, 60),
    ),
}


def test_media_headers(spark, tmp_path):
    for name, (content, _) in MEDIA_FILES.items():
        (tmp_path / name).write_bytes(content)
    got = {r["name"]: r for r in media.read_media_info(spark, str(tmp_path)).collect()}
    assert {n: tuple(got[n][c] for c in ("kind", "width", "height", "frames")) for n in got} == {n: want for n, (_, want) in MEDIA_FILES.items()}
    assert (got["h.wav"]["samples"], got["h.wav"]["rate"], got["h.wav"]["seconds"]) == (8000, 16000, 0.5)
    assert got["d.gif"]["seconds"] == 0.6 and got["k.mp4"]["seconds"] == 2.4 and (got["k.mp4"]["rate"], got["k.mp4"]["samples"]) == (48000, 96000)
    assert got["a.png"]["length"] == len(MEDIA_FILES["a.png"][0])
    odd = spark.createDataFrame([(None, 1), (bytearray(), 2)], "content binary, info int")
    assert [r["info"]["kind"] for r in media.with_info(odd).collect()] == [None, None]


def test_headers_that_break_off_are_no_error():
    for content, _ in MEDIA_FILES.values():
        for n in range(min(len(content), 400)):
            media.read_header(content[:n])


def test_sizes_follow_the_media_of_a_row(spark):
    info = spark.createDataFrame([("a.png", "/m/a.png", "png", 4, 5), ("b.mp4", "/m/b.mp4", "mp4", 6, 7)], "name string, path string, kind string, width int, height int")
    info = info.withColumns({"frames": F.lit(9).cast("long"), "seconds": F.lit(3.0), "samples": F.lit(None).cast("long"), "rate": F.lit(None).cast("int")})
    rows = spark.createDataFrame([(1, ["a.png", "none.png", "/m/a.png"], None, None), (2, None, None, None), (3, ["a.png"], ["/m/b.mp4"], [])], "rid int, _images array<string>, _videos array<string>, _audios array<string>")
    out = {r["rid"]: r for r in media.with_sizes(rows, info, "rid").collect()}
    assert [x and x["width"] for x in out[1]["_image_sizes"]] == [4, None, 4] and out[2]["_image_sizes"] is None and out[1]["_video_sizes"] is None
    assert out[3]["_video_sizes"][0]["frames"] == 9 and out[3]["_audio_sizes"] is None and len(out[3]["_image_sizes"]) == 1


def test_shards_follow_names():
    files = [f"/r/{n}" for n in ("data/train-00000-of-00002.parquet", "data/train-00001-of-00002.parquet", "data/validation-0.parquet", "en/test/part.parquet", "de_dev.parquet", "readings/a.parquet")]
    find = lambda **k: [f[3:] for f in mirror.shards(files, "/r", DatasetSpec("x", "huggingface", **k))]
    assert find() == ["data/train-00000-of-00002.parquet", "data/train-00001-of-00002.parquet"]
    assert find(folder="data", split="validation") == ["data/validation-0.parquet"] and find(subset="en", split="test") == ["en/test/part.parquet"]
    assert find(subset="de", split="validation") == ["de_dev.parquet"] and find(folder="readings") == ["readings/a.parquet"]
    assert find(folder="data", split="train+validation") == ["data/train-00000-of-00002.parquet", "data/train-00001-of-00002.parquet", "data/validation-0.parquet"]
    for odd in ({"subset": "fr"}, {"split": "test", "folder": "data"}, {"folder": "none"}):
        with pytest.raises(ValueError, match="no files"):
            find(**odd)


def test_mirrors_are_read_and_streamed(spark, tmp_path):
    base = tmp_path / "hub" / "who" / "what"
    (base / "sub").mkdir(parents=True)
    (base / "sub" / "train-0.json").write_text('[{"a": 1}, {"a": 2}]')
    (base / "sub" / "train-1.jsonl").write_text('{"a": 3, "b": "x"}\n')
    (base / "test.csv").write_text("a,b\n4,y\n")
    (base / ".hidden.json").write_text("{}")
    (base / "dataset_info.json.txt").write_text("note")
    spec = DatasetSpec("who/what", "openmind", subset="sub")
    assert sorted((r["a"], r["b"]) for r in mirror.read_mirror(spark, str(tmp_path / "hub"), spec).collect()) == [(1, None), (2, None), (3, "x")]
    mirror.register_mirror("openmind", str(tmp_path / "hub"))
    assert readers.read_dataset(spark, DatasetSpec("who/what", "openmind", split="test")).first()["b"] == "y"
    stream = readers.stream_dataset(spark, DatasetSpec("who/what", "openmind", split="test"))
    stream.writeStream.format("memory").queryName("mirrored").trigger(availableNow=True).start().awaitTermination()
    assert [r["b"] for r in spark.table("mirrored").collect()] == ["y"]
    with pytest.raises(ValueError):
        mirror.read_mirror(spark, str(tmp_path / "hub"), DatasetSpec("no/such", "openmind"))
    with pytest.raises(ValueError):
        mirror.register_mirror("elsewhere", str(tmp_path))
