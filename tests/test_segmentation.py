"""Segmentation against all ways to cut a text and all ways to mark it."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from loomspark.operators import metrics
from loomspark.operators.segmentation import FOLLOWS, NEVER, STATES, Segmenter, segmented, train_segmenter

WORDS = [("我们", 50), ("我", 30), ("们", 2), ("喜欢", 40), ("喜", 1), ("北京", 30), ("北京大学", 12), ("大学", 25), ("大学生", 9), ("学生", 20), ("生", 4), ("的", 90), ("研究生", 5), ("研究", 15)]


@pytest.fixture(scope="module")
def model(spark):
    rows = spark.createDataFrame([*WORDS, ("我们", 1), ("", 5), (None, 3), ("错", 0)], "word string, n long")
    return train_segmenter(rows)


def all_cuts(text):
    if not text:
        yield []
    for i in range(1, len(text) + 1):
        for rest in all_cuts(text[i:]):
            yield [text[:i], *rest]


def test_the_cut_is_the_most_probable_one(model):
    rng = random.Random(1)
    characters = sorted({c for w, _ in WORDS for c in w}) + ["错", "字"]
    for _ in range(300):
        text = "".join(rng.choice(characters) for _ in range(rng.randint(1, 9)))
        if rng.random() < 0.5:
            text = "".join(rng.choice(WORDS)[0] for _ in range(3))[:9]
        chance = lambda cut: sum(math.log(model.words.get(w, 1)) - model.total for w in cut)
        possible = [c for c in all_cuts(text) if all(len(w) == 1 or w in model.words for w in c)]
        got = model.cuts(text)
        assert "".join(got) == text and chance(got) == pytest.approx(max(map(chance, possible)), abs=1e-9)


def test_unknown_runs_follow_the_best_marks(model):
    rng = random.Random(2)
    characters = sorted({c for w, _ in WORDS for c in w}) + ["错"]
    for _ in range(200):
        text = "".join(rng.choice(characters) for _ in range(rng.randint(2, 6)))

        def chance(marks, text=text):
            value = model.start.get(marks[0], NEVER) + model.shows[marks[0]].get(text[0], NEVER)
            for a, b, c in zip(marks, marks[1:], text[1:]):
                value += model.moves.get((a, b), NEVER) + model.shows[b].get(c, NEVER)
            return value

        best = max(chance(m) for m in itertools.product(STATES, repeat=len(text)) if m[-1] in "ES" and all(a in FOLLOWS[b] for a, b in zip(m, m[1:])))
        words = model.unknown(text)
        marks = "".join("S" if len(w) == 1 else "B" + "M" * (len(w) - 2) + "E" for w in words)
        assert "".join(words) == text
        # A path may begin inside a word if nothing else is possible; then its words say less.
        assert chance(marks) <= best + 1e-6 and (best < NEVER / 2 or chance(marks) == pytest.approx(best))


def test_texts_become_words(spark, model):
    assert model.segment("我们喜欢北京大学的研究生") == ["我们", "喜欢", "北京大学", "的", "研究生"]
    assert model.segment("我 love 北京,2024!") == ["我", "love", "北京", ",", "2024", "!"]
    df = spark.createDataFrame([(1, "大学生的"), (2, ""), (3, None), (4, "a b")], "i int, text string").repartition(2)
    assert {r["i"]: r["words"] for r in segmented(df, model).collect()} == {1: ["大学生", "的"], 2: [], 3: None, 4: ["a", "b"]}
    assert Segmenter({}).segment("我们") == ["我", "们"] and train_segmenter(spark.createDataFrame([], "word string, n long")).words == {}
    assert set(train_segmenter(spark.createDataFrame(WORDS, "word string, n long"), most_words=2).words) == {"的", "我们"}


def test_scores_use_the_words(spark, model):
    df = spark.createDataFrame([("我们喜欢北京", "我们喜欢北京大学")], "said string, wanted string")
    out = df.select(metrics.similarity_scores(F.col("said"), F.col("wanted"), model.segment).alias("s")).first()["s"]
    assert out["rouge_1"] == pytest.approx(100 * 2 / 3, abs=1e-3) and out["rouge_l"] == pytest.approx(100 * 2 / 3, abs=1e-3) and out["rouge_2"] == pytest.approx(50.0)


def test_segmented_scores_cut_each_text_once(spark, data):
    from loomspark.plans import catalogue

    plan = catalogue.queries()["agg_rouge_segmented"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    # One step cuts, one scores, and nothing is scored that the query doesn't return.
    assert plan.count("ArrowEvalPython") == 2
    assert "bleu" not in plan
