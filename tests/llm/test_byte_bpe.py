"""Byte-level BPE by distinct words against the library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from loomspark.llm import byte_bpe, registry

ODD = [
    None, "", " ", "\n\n  \t", "a  b\n c ", "I'll we've it's 'S", "x\x1cy\x1f z\x85w\x0b\x0c", "ÀÉ é ñ ß ſ", "漢字かな 😀😀🏳️‍🌈", "١٢٣ ²³½ Ⅷ", "_a_b__!'s", "​　x  y",
    "a" * 3000, "ab" * 1500 + " of", "<|endoftext|>", "\x00\x01�\U0010ffff", "́́ combining",
]


@pytest.fixture(scope="module")
def library():
    ranks = byte_bpe.read_ranks(byte_bpe.default_ranks_path())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(4)
    out = [*ODD, *("".join(rng.choice("abcdeth in's!_<|>\n\t\r\x1d ÉéñßΣ漢😀́9²") for _ in range(rng.randint(0, 60))) for _ in range(1500))]
    return out + ["".join(rng.choice("abetionhsr ") for _ in range(rng.randint(0, 80))) for _ in range(800)]


def test_texts_are_encoded_like_the_library_and_decode_whole(spark, library):
    rows = [(i % 2000, t, "x", i) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, slice string, number int").repartition(3)
    out = byte_bpe.decode(byte_bpe.encode(df, ["number", "slice", "doc_id"])).collect()
    assert len(out) == len(rows)
    for r in out:
        text = rows[r["number"]][1] or ""
        assert r["ids"] == library.encode_ordinary(text), repr(text)
        assert bytes(r["decoded"]) == text.encode() and r["slice"] == "x" and r["doc_id"] == r["number"] % 2000


def test_words_across_slices_are_encoded_once(spark, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "SLICE_ROWS", 3)
    df = spark.createDataFrame([(i, f"the same words and {i % 5}" * (i % 3)) for i in range(60)], "doc_id long, text string").repartition(4)
    slices = byte_bpe.slices_of(df, "text", ["doc_id"], None).collect()
    rows = [r for r in slices if r["bucket"] is not None]
    pairs = []
    for r in rows:
        ends = np.cumsum(byte_bpe.unpack(bytes(r["lengths"]))).tolist()
        pairs += [(r["slice"], bytes(r["words"])[a:b]) for a, b in zip([0, *ends], ends)]
    assert len({(r["slice"], r["bucket"]) for r in rows}) == len(rows)
    assert len(pairs) == len(set(pairs)) and len({s for s, _ in pairs}) >= 16
    for r in byte_bpe.encode(df, ["doc_id"]).collect():
        assert r["ids"] == library.encode_ordinary(f"the same words and {r['doc_id'] % 5}" * (r["doc_id"] % 3))


def test_many_distinct_words_take_wider_numbers(spark, library):
    text = " ".join(f"{i:x}z" for i in range(70_000))
    row = byte_bpe.decode(byte_bpe.encode(spark.createDataFrame([(1, text)], "a long, text string"), ["a"])).first()
    assert row["ids"] == library.encode_ordinary(text) and bytes(row["decoded"]) == text.encode()


def test_odd_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, ids string")
    assert byte_bpe.encode(df, ["doc_id", "ids"]).columns == ["doc_id", "ids"] and byte_bpe.encode(df, ["doc_id"]).count() == 0
    none = spark.createDataFrame([(None, None), (None, None), (1, "")], "doc_id long, text string")
    assert sorted(map(str, byte_bpe.encode(none, ["doc_id"]).collect())) == ["Row(doc_id=1, ids=[])", "Row(doc_id=None, ids=[])", "Row(doc_id=None, ids=[])"]
    ids = spark.createDataFrame([(1, None, "old"), (2, [0, None, 5], "old")], "doc_id long, ids array<int>, decoded string")
    assert {r["doc_id"]: len(r["decoded"]) for r in byte_bpe.decode(ids).collect()} == {1: 0, 2: 2}
    with pytest.raises(Exception, match="token-byte table lacks"):
        byte_bpe.decode(spark.createDataFrame([([10**6],)], "ids array<int>")).collect()


def test_texts_stay_where_they_are(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string")
    plan = byte_bpe.encode(df, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(slice") == 1 and "Exchange hashpartitioning(home" not in plan


def test_numbers_are_packed_whole():
    rng = np.random.default_rng(2)
    for top in (1, 128, 1 << 14, 1 << 21, 1 << 28):
        numbers = np.concatenate([rng.integers(0, top, 500), [top - 1, 0]])
        assert (byte_bpe.unpack(byte_bpe.pack(numbers)) == numbers).all()
    assert byte_bpe.pack(np.zeros(0, np.int64)) == b"" and len(byte_bpe.unpack(b"")) == 0


def test_long_words_merge_like_the_library(library):
    ranks = byte_bpe.read_ranks(byte_bpe.default_ranks_path())
    rng = random.Random(9)
    for _ in range(2000):
        word = "".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 60)))
        assert byte_bpe.encode_word(word.encode(), ranks) == library.encode_ordinary(word)
    assert len(byte_bpe.encode_word(b"ab" * 200_000, ranks)) > 1


def test_op12_on_whole_tables(spark, data, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    out = registry.queries()["op12_distinct_word_shuffle"](spark, data).collect()
    assert len(out) == len(docs)
    for r in out:
        ids = library.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
