"""Selection and numbering against sorted lists, and streams that lose no row."""

from __future__ import annotations

import json
import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from loomspark.operators import metrics, mixing, selection
from loomspark.plans.prepare import DataOptions, get_dataset
from loomspark.streaming import streams


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rank_by_digits(spark, monkeypatch):
    monkeypatch.setattr(selection, "GATHERED", 3)
    rng = random.Random(1)
    values = [rng.choice([rng.randint(-5, 5), rng.randint(-(2**63), 2**63 - 1), 7]) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(3)
    key = selection.hex_of(F.col("v"), "bigint")
    ordered = sorted(values)
    for rank in (0, 1, 57, 200, 398, 399):
        found, before = selection.key_at(df, key, rank, 16)
        assert int(found, 16) - 2**63 == ordered[rank] and before == ordered.index(ordered[rank])
    assert selection.key_at(df, key, 400, 16) is None and selection.key_at(df.limit(0), key, 0, 16) is None
    for n in (0, 1, 130, 399, 400, 500):
        assert sorted(r["v"] for r in selection.first_of(df, key, n, 16).collect()) == ordered[:n]


def test_samples_are_filters(spark):
    df = spark.range(3000).select((F.col("id") * 7 - 50).alias("k"), F.lit("x").alias("more"))
    sample = mixing.sample_rows(df, 300, "k")
    assert "TakeOrdered" not in plan_of(sample) and "Sort" not in plan_of(sample) and "Exchange" not in plan_of(sample)
    want = [r["k"] for r in df.orderBy(mixing.hash_order(42, F.col("k")), "k").limit(300).collect()]
    assert sorted(r["k"] for r in sample.collect()) == sorted(want)
    parts = mixing.split(df, 0.1, "k")
    assert "Exchange" not in plan_of(parts["validation"]) and sorted(r["k"] for r in parts["validation"].collect()) == sorted(want)
    assert parts["train"].count() == 2700
    assert sorted(r["k"] for r in mixing.first_rows(df, 5, "k").collect()) == [-50, -43, -36, -29, -22]
    assert [r["k"] for r in mixing.page(df, 3, "k").collect()] == [-8, -1]
    again = mixing.sample_rows(df.limit(10), 25, "k")
    assert again.count() == 25 and again.where("draw = 0").count() == 10


def test_repeated_keys_and_other_kinds(spark):
    df = spark.createDataFrame([(1, "b")] * 50 + [(2, "a")] * 3 + [(None, None)] * 2, "k int, s string")
    assert mixing.sample_rows(df, 20, "k").count() == 20
    assert [r["s"] for r in mixing.first_rows(df, 4, "s").orderBy("s").collect()] == [None, None, "a", "a"]
    assert sorted(map(str, mixing.first_rows(df, 3, "k").collect())) == ["Row(k=1, s='b')", "Row(k=None, s=None)", "Row(k=None, s=None)"]
    assert mixing.page(df, 1, "s", 3).count() == 3
    parts = mixing.split(spark.range(40).withColumnRenamed("id", "k"), 7, "k")
    assert parts["validation"].count() == 7 and parts["train"].count() == 33
    assert mixing.split(spark.range(3).withColumnRenamed("id", "k"), 9, "k")["train"].count() == 0


@pytest.mark.parametrize("kind", ["json", "parquet"])
def test_rows_are_numbered_where_they_stand(spark, tmp_path, kind):
    path = str(tmp_path / kind)
    for i in range(3):
        spark.range(10 * i, 10 * i + 10).coalesce(1).write.mode("append").format(kind).save(path)
    df = spark.read.format(kind).load(path)
    out = selection.number_in_place(df, touched=["id"])
    assert "hashpartitioning" not in plan_of(out).split("BroadcastExchange")[0] and "rangepartitioning" not in plan_of(out)
    rows = out.collect()
    assert sorted(r["rid"] for r in rows) == list(range(30))
    assert [r["id"] for r in sorted(rows, key=lambda r: r["rid"])] == [r["id"] for r in df.collect()]


def arrivals(spark, path, sizes, base=0):
    """A stream of one file a micro-batch, of these numbers of rows."""
    at = base
    for n in sizes:
        spark.range(at, at + n).withColumnRenamed("id", "k").coalesce(1).write.mode("append").parquet(path)
        at += n
    return spark.readStream.schema("k long").option("maxFilesPerTrigger", 1).parquet(path)


def gathered(strategy, probabilities, spark, folder, parts, rest=True):
    got = {}
    sink = lambda df, n: got.__setitem__(n, [tuple(r) for r in df.select("mix_pos", "ds_idx", "k").orderBy("mix_pos").collect()])
    settings = (strategy, probabilities, 5)
    streams.interleaved_batches(parts, "k", sink, folder, *settings).awaitTermination()
    if rest:
        streams.interleaved_rest(spark, len(parts), "k", sink, folder, *settings)
    return [r for n in sorted(got) for r in got[n]]


@pytest.mark.parametrize("strategy,probabilities", [("interleave_under", None), ("interleave_over", None), ("interleave_under", [0.6, 0.4]), ("interleave_over", [0.2, 0.8])])
def test_streams_are_mixed_as_whole_datasets(spark, tmp_path, strategy, probabilities):
    parts = [arrivals(spark, str(tmp_path / "a"), (10, 10, 10)), arrivals(spark, str(tmp_path / "b"), (15, 5, 10, 3), 1000)]
    got = gathered(strategy, probabilities, spark, str(tmp_path / "c"), parts)
    whole = [spark.range(30).select(F.col("id").alias("k"), F.col("id").alias("rid")), spark.range(33).select((F.col("id") + 1000).alias("k"), F.col("id").alias("rid"))]
    want = [tuple(r) for r in mixing.mix(whole, strategy, probabilities, 5).select("mix_pos", "ds_idx", "k").orderBy("mix_pos").collect()]
    assert got == want and [r[0] for r in got] == list(range(len(want)))
    if strategy == "interleave_under" and not probabilities:
        assert len(got) == 60


def test_an_interrupted_mix_goes_on(spark, tmp_path):
    paths = [str(tmp_path / "a"), str(tmp_path / "b")]
    first = gathered("interleave_under", None, spark, str(tmp_path / "c"), [arrivals(spark, paths[0], (4, 1)), arrivals(spark, paths[1], (2,), 100)], rest=False)
    second = gathered("interleave_under", None, spark, str(tmp_path / "c"), [arrivals(spark, paths[0], (3,), 5), arrivals(spark, paths[1], (7, 1), 102)])
    want = [(2 * i + d, d, i + 100 * d) for i in range(8) for d in (0, 1)]
    assert first == want[:4] and first + second == want


def test_the_buffer_shuffles_over_batches(spark, tmp_path):
    stream = arrivals(spark, str(tmp_path / "in"), (20, 20, 5, 20))
    runs = []
    for name in ("one", "two"):
        got = {}
        sink = lambda df, n, got=got: got.__setitem__(n, [r["k"] for r in df.collect()])
        streams.shuffled_batches(stream, "k", sink, str(tmp_path / name), 3, buffer=12).awaitTermination()
        streams.shuffled_rest(spark, "k", sink, str(tmp_path / name), 3)
        runs.append(got)
    assert runs[0] == runs[1] and [len(runs[0][n]) for n in sorted(runs[0])] == [8, 20, 5, 20, 12]
    assert sorted(k for batch in runs[0].values() for k in batch) == list(range(65))
    arrived = [range(20), range(20, 40), range(40, 45), range(45, 65)]
    assert any(k < min(arrived[n]) for n in (1, 2, 3) for k in runs[0][n]) and all(batch != sorted(batch) for batch in runs[0].values())


def test_streamed_preparation_honours_its_settings(spark, tmp_path):
    for name, n in (("a", 3), ("b", 7)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(json.dumps({"instruction": f"ask {name}{i}", "output": f"answer {name}{i}"}) for i in range(n)))
    registry = {n: {"file_name": f"{n}.jsonl", "columns": {"prompt": "instruction", "response": "output"}} for n in "ab"}
    options = DataOptions(template="default", dataset=("a", "b"), dataset_dir=str(tmp_path), streaming=True)

    def counts(**given):
        out = get_dataset(spark, replace(options, **given), "sft", registry)
        name = f"s{len(spark.catalog.listTables())}_{random.randint(0, 10**9)}"
        out["train"].writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
        texts = ["".join(chr(i) for i in r["input_ids"] if i < 0x110000) for r in [*spark.table(name).collect(), *(out["validation"].collect() if "validation" in out else [])]]
        assert all("answer" in t for t in texts)
        return spark.table(name).count(), out["validation"].count() if "validation" in out else None, len(set(texts))

    assert counts() == (10, None, 10)
    assert counts(mix_strategy="interleave_under") == (6, None, 6)
    assert counts(mix_strategy="interleave_over", val_size=2) == (12, 2, 10)
    assert counts(val_size=4) == (6, 4, 10)
    train, _, texts = counts(mix_strategy="interleave_under", interleave_probs=(0.5, 0.5))
    assert 3 <= train <= 10 and texts == train


@pytest.mark.parametrize("parts", [1, 7])
def test_scans_go_over_ranges(spark, parts):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.uniform(-1, 1), rng.choice([None, rng.uniform(-2, 2)])) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i int, f double, x double").repartition(3)
    got = {r["i"]: r["s"] for r in mixing.linear_scan(df, [F.col("i")], F.col("f"), F.col("x"), "s", ["g"], parts).collect()}
    last = {}
    for g, i, f, x in rows:
        last[g] = f * last.get(g, 0.0) + (x or 0.0)
        assert got[i] == pytest.approx(last[g], abs=1e-12)
    assert len(got) == 500 and mixing.linear_scan(df.limit(0), [F.col("i")], F.col("f"), F.col("x"), "s", ["g"]).count() == 0


def test_averages_of_long_series(spark):
    xs = [math.sin(i) + i % 3 for i in range(900)]
    df = spark.createDataFrame([(i, x, "r") for i, x in enumerate(xs)], "i int, x double, run string").repartition(4)
    w = 1.8 * (1 / (1 + math.exp(-0.05 * 900)) - 0.5)
    for group in (None, "run"):
        got = [r["smoothed"] for r in metrics.smoothed_rows(df, "x", ["i"], group).orderBy("i").collect()]
        last = xs[0]
        for x, y in zip(xs, got):
            last = w * last + (1 - w) * x
            assert y == pytest.approx(last, abs=1e-9)
