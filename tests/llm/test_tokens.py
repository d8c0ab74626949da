"""Tokenization, packing and language-model scores against the library and brute force."""

from __future__ import annotations

import hashlib
import json
import math
import random
import zlib
from array import array
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomspark.llm import bpe_automaton, lm_scoring, packing, registry
from loomspark.llm.common import default_tokenizer_path

ODD = [
    None, "", " ", "\n\t", "<|endoftext|>a<|startoftext|>", "<|endoftext", "İstanbul Σίσυφος ΣΑΣ", "a'sb 's's ''s it's I'LL", "x​y z\x1cq",
    "ﬁ Å é", "²³½ Ⅷ ٣", "_a_b__!'s", "漢字かな 😀😀", " 　x", "a" * 5000, "the" * 500 + " of", "mañana", "it,sg.And,then",
]


@pytest.fixture(scope="module")
def bpe():
    return bpe_automaton.open_bpe(default_tokenizer_path())


LIBRARY = Tokenizer.from_file(default_tokenizer_path())


def library_ids(bpe, text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_encoding_is_the_librarys(bpe):
    rng = random.Random(3)
    texts = [*ODD, *("".join(rng.choice("abcdeth in's!_<|>\n\tÉé²İßΣ漢😀́") for _ in range(rng.randint(0, 40))) for _ in range(1500))]
    texts += ["".join(rng.choice("abetionhsr") for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    for text in texts:
        assert array("I", bpe.encode(text)).tolist() == library_ids(bpe, text), repr(text)


def test_columns_are_encoded_like_single_texts(bpe):
    rng = random.Random(8)
    texts = [*ODD, *("".join(rng.choice("abcdeth ins.,!_-\n\tÉéßñ0123…“”'") for _ in range(rng.randint(0, 60))) for _ in range(2000))]
    texts += ["lorem ipsum " * rng.randint(1, 50) + rng.choice([".", "!!", " ", "x"]) for _ in range(300)]
    for got, text in zip(bpe.encode_column(pa.array(texts, pa.string())), texts):
        assert array("I", got).tolist() == library_ids(bpe, text), repr(text)
    assert bpe.encode_column(pa.array([], pa.string())) == [] and bpe.encode_column(pa.array([None])) == [b""]
    for run in (". ", "!! ", " a", "a b", "", "a\x0b.\x0b!\x0cb", "a1b22.c"):
        assert array("I", bpe.encode(run)).tolist() == library_ids(bpe, run)


def test_long_words_and_repeats(bpe):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abetionhsr") for _ in range(n)) for n in (511, 512, 513, 20000, 40000)] + ["the" * 9000, "漢字かな" * 3000]
    for text, got in zip(texts, bpe.encode_column(pa.array(texts))):
        assert array("I", got).tolist() == library_ids(bpe, text)


def test_other_rules_are_the_librarys(tmp_path):
    """Files with other normalizers, splits and decoders; what can't be expressed is refused."""
    spec = json.loads(Path(default_tokenizer_path()).read_text())
    texts = ["Hello World the CAT", "it's  10 <|endoftext|>cafés", "", None]
    changes = {
        "cased": {"normalizer": None},
        "split": {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}},
        "decoder": {"decoder": {"type": "BPEDecoder", "suffix": "</w>"}},
        "whole": {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": False}},
    }
    for name, change in changes.items():
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(spec | change))
        mine, theirs = bpe_automaton.WordBpe(str(path)), Tokenizer.from_file(str(path))
        for text, got in zip(texts, mine.encode_column(pa.array(texts, pa.string()))):
            ids = theirs.encode(text or "", add_special_tokens=False).ids
            assert array("I", got).tolist() == ids, (name, text)
            assert mine.decode(got) == theirs.decode(ids, skip_special_tokens=False), (name, text)
    for change in ({"dropout": 0.1}, {"unk_token": "x"}, {"continuing_subword_prefix": "##"}):
        path = tmp_path / "refused.json"
        path.write_text(json.dumps(spec | {"model": spec["model"] | change}))
        with pytest.raises(ValueError):
            bpe_automaton.WordBpe(str(path))


def test_byte_level_vocabulary(bpe):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    mine, theirs = bpe_automaton.WordBpe(path), Tokenizer.from_file(path)
    texts = [t for t in ODD if t is not None]
    for text, got in zip(texts, mine.encode_column(pa.array(texts, pa.string()))):
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert array("I", got).tolist() == ids, repr(text)
        assert mine.decode(got) == theirs.decode(ids, skip_special_tokens=False)


def test_decoding_emits_labels(bpe):
    for text in ODD:
        assert bpe.decode(bpe.encode(text)) == LIBRARY.decode(library_ids(bpe, text), skip_special_tokens=False)


def test_automaton_accepts_only_what_merging_gives(bpe):
    def merged(word):
        ranks = {pair: i for i, pair in enumerate(merges)}
        parts = [*word[:-1], word[-1] + "</w>"]
        while len(parts) > 1 and (best := min(zip(parts, parts[1:]), key=lambda p: ranks.get(p, math.inf))) in ranks:
            out, i = [], 0
            while i < len(parts):
                joined = parts[i : i + 2] == list(best)
                out.append("".join(best) if joined else parts[i])
                i += 1 + joined
            parts = out
        return parts

    merges = [("a", "b"), ("ab", "a"), ("a", "a"), ("b", "a</w>"), ("aa", "b"), ("ab", "ab"), ("aba", "b</w>")]
    labels = dict.fromkeys(["a", "b", "a</w>", "b</w>", *("".join(m) for m in merges)])
    vocab = {label: i for i, label in enumerate(labels)}
    automaton = bpe_automaton.TokenAutomaton(vocab, merges)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 14))) for rng in [random.Random(2)] for _ in range(500)]
    assert [automaton.run_long(np.frombuffer(w.encode(), np.uint8)).tolist() for w in words] == [automaton.run(w) for w in words]
    rng = random.Random(1)
    for _ in range(3000):
        word = "".join(rng.choice("ab") for _ in range(rng.randint(1, 14)))
        assert [automaton.labels[i] for i in automaton.run(word)] == merged(word), word


def test_encode_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(i, t, "mine", 1.5) for i, t in enumerate(ODD)], "doc_id long, text string, ids string, extra double")
    out = bpe_automaton.encode(df)
    assert out.columns == ["doc_id", "text", "extra", "ids", "decoded"]
    rows = {r["doc_id"]: r for r in out.collect()}
    assert len(rows) == len(ODD) and bytes(rows[0]["ids"]) == b"" and rows[0]["decoded"] == ""
    again = {r["doc_id"]: r["decoded"] for r in bpe_automaton.decode(out.drop("decoded")).collect()}
    assert again == {i: r["decoded"] for i, r in rows.items()}
    assert bpe_automaton.encode(df.limit(0)).count() == 0


def test_op6_digests(spark, data, bpe):
    texts = dict(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect())
    for r in registry.queries()["op6_tokenization_automaton"](spark, data).collect():
        ids = library_ids(bpe, texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def check_packing(pieces, ids_of, capacity=2048):
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc, parts in by_doc.items():
        ids, at = array("I", ids_of[doc]), 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at].tobytes())
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    assert set(by_doc) == set(ids_of)
    sizes = [sum(r["length"] for r in p) for p in by_sequence.values()]
    return sum(sizes), sum(0 if n & (n - 1) == 0 else capacity - n for n in sizes)


def test_op5_pieces_cover_documents(spark, data, bpe):
    texts = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    pieces = registry.queries()["op5_harmonic_packing"](spark, data).collect()
    used, padded = check_packing(pieces, {r["doc_id"]: [*library_ids(bpe, r["text"]), 1] for r in texts})
    assert padded < 0.005 * used


def test_workers_fill_bins_of_a_fixed_count():
    rng = random.Random(5)
    for worker in (0, 3):
        bins, out, held = packing.Bins(worker, 2048), [], 0
        for doc in range(3000):
            n = int(rng.paretovariate(0.7) * 9) % 9000 + 1
            start = 0
            for size in packing.cut_lengths(n):
                done = bins.add(packing.Piece(doc, start, doc.to_bytes(4, "little") * size, n))
                assert not done or {2048 // len(p) for p in done} == {len(done)}
                out += done
                start += size
            held = max(held, len(bins.open))
        rest = bins.rest()
        assert held <= 70 and not bins.open and len({p.sequence_id for p in out} & {p.sequence_id for p in rest}) == 0
        sizes = Counter()
        for p in rest:
            assert p.offset == sizes[p.sequence_id] and p.sequence_id >> 33 == worker
            sizes[p.sequence_id] += len(p)
        assert all(n & (n - 1) == 0 for n in sizes.values())
        covered = Counter()
        for p in sorted(out + rest, key=lambda p: (p.doc_id, p.start)):
            assert p.start == covered[p.doc_id] and p.ids == p.doc_id.to_bytes(4, "little") * len(p)
            covered[p.doc_id] += len(p)
            assert covered[p.doc_id] <= p.doc_tokens
        assert len(covered) == 3000


def test_packing_moves_nothing(spark):
    df = spark.createDataFrame([("x", "a b c", 1)] * 3 + [(None, None, 2)], "doc_id string, text string, length int")
    out = packing.pack_documents(df)
    assert "Exchange" not in out._jdf.queryExecution().toString()
    assert Counter(r["doc_id"] for r in out.where("start = 0").collect()) == {"x": 3, None: 1}


def test_packing_edges(spark, bpe):
    texts = [None, "", "a", "the " * 9000, *["word " * n for n in (10, 63, 64, 2046, 2047, 2048)]]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, offset int")
    check_packing(packing.pack_documents(df, payload="crc").collect(), {i: [*library_ids(bpe, t), 1] for i, t in enumerate(texts)})
    assert packing.pack_documents(df.limit(0), payload="crc").count() == 0


def test_sequences_hold_the_pieces(spark, bpe):
    texts = ["of the " * 700, "a b c", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces = packing.pack_documents(df)
    whole = {r["sequence_id"]: array("I", bytes(r["ids"])) for r in packing.assemble_sequences(pieces).collect()}
    got = Counter()
    for r in pieces.collect():
        ids = whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert ids.tobytes() == bytes(r["ids"])
        got[r["doc_id"]] += len(ids)
    assert got == {i: len(library_ids(bpe, t)) + 1 for i, t in enumerate(texts)}
    assert all(len(w) == 2048 or len(w) & (len(w) - 1) == 0 for w in whole.values())


@pytest.mark.parametrize("n", [0, 1, 63, 64, 100, 2047, 2048, 2049, 5000])
def test_cut_lengths(n):
    parts = packing.cut_lengths(n)
    assert sum(parts) == n and all(0 < p <= 2048 for p in parts) and parts == sorted(parts, reverse=True)


def test_language_model_scores(spark, bpe):
    texts = ["the cat of the cat", "a dog and a dog", "the the the", None, "", "zebra", "the cat of the cat"]
    targets = {0, 2}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(0,), (2,), (2,), (None,)], "doc_id long")
    got = {r["doc_id"]: r for r in lm_scoring.cross_entropy_difference(df, labels).collect()}
    vocabulary = len(bpe.arc_labels)
    uni, bi, starts = [Counter(), Counter()], [Counter(), Counter()], [0, 0]
    for i, t in enumerate(texts):
        m, ids = (0 if i in targets else 1), library_ids(bpe, t)
        starts[m] += bool(ids)
        uni[m].update(ids)
        bi[m].update(zip([vocabulary, *ids], ids))
    for i, t in enumerate(texts):
        ids = library_ids(bpe, t)
        assert got[i]["n_tokens"] == len(ids)
        if not ids:
            assert got[i]["score"] is None
            continue
        loss = []
        for m in range(2):
            own = m == (0 if i in targets else 1)
            u, b = Counter(uni[m]), Counter(bi[m])
            if own:
                u.subtract(ids)
                b.subtract(zip([vocabulary, *ids], ids))
            n, total = 0.0, sum(u.values())
            for p, x in zip([vocabulary, *ids], ids):
                context = starts[m] - own if p == vocabulary else u[p]
                n -= math.log(0.7 * b[p, x] / max(1, context) + 0.3 * (u[x] + 1) / (total + vocabulary))
            loss.append(n / len(ids))
        assert np.allclose([got[i]["target_loss"], got[i]["background_loss"], got[i]["score"]], [*loss, loss[0] - loss[1]])
    assert got[2]["score"] < 0
    assert lm_scoring.cross_entropy_difference(df.limit(0), labels).count() == 0
    assert lm_scoring.cross_entropy_difference(df, labels.limit(0)).where(F.col("score").isNotNull()).count() == 5


def test_bigrams_never_share_a_counter(spark, bpe):
    """Two pairs that 2^22 hash buckets would count together; blocks don't matter either."""
    vocabulary = len(bpe.arc_labels)
    words = [w for w in (a + b + c for a in "bcdfglmnprst" for b in "aeiou" for c in "bdgklmnprst") if len(library_ids(bpe, w)) == 1]
    ids = {w: library_ids(bpe, w)[0] for w in words}
    seen = {}
    for p in words:
        for x in words:
            bucket = ((ids[p] * (vocabulary + 1) + ids[x] + 1) * 0x9E3779B97F4A7C15 % 2**64) >> 42
            if bucket in seen and len({p, x, *seen[bucket]}) == 4:
                break
            seen[bucket] = (p, x)
        else:
            continue
        break
    (q, y), other = seen[bucket], next(w for w in words if w not in (p, x, *seen[bucket]))
    texts = [f"{p} {x}"] * 50 + [f"{q} {other}"] * 9 + [f"{q} {y}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i,) for i in range(0, 50, 2)], "doc_id long")
    rows = {r["doc_id"]: r for r in lm_scoring.cross_entropy_difference(df, labels).collect()}
    loss = -math.log(0.7 * 9 / 34 + 0.3 * 10 / (68 + vocabulary)) - math.log(0.3 * 1 / (68 + vocabulary))
    assert math.isclose(rows[59]["background_loss"], loss / 2, rel_tol=1e-9)
    small = {r["doc_id"]: r for r in lm_scoring.cross_entropy_difference(df, labels, block_tokens=3).collect()}
    assert len(small) == 60 and all(np.allclose(small[i][1:], rows[i][1:]) for i in rows)


def test_op5_digests_come_from_the_ids_packed(spark, data, bpe, monkeypatch):
    import corpus_pipeline

    made = []
    pack = packing.pack_documents
    monkeypatch.setattr(packing, "pack_documents", lambda *a, **k: made.append(pack(*a, **k)) or made[-1])
    got = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in registry.queries()["op5_harmonic_packing"](spark, data).collect()}
    assert got == {(r["doc_id"], r["start"]): zlib.crc32(bytes(r["ids"])) for r in made[0].collect()}
    docs = spark.createDataFrame([(1, "of the " * 700), (2, "a b c")], "doc_id long, text string")
    out = corpus_pipeline.pack_sequences(spark, docs, data)
    ids = {i: b"".join(bytes(r["ids"]) for r in sorted(out.where(f"doc_id = {i}").collect(), key=lambda r: r["start"])) for i in (1, 2)}
    assert array("I", ids[1]).tolist() == [*library_ids(bpe, "of the " * 700), 1] and array("I", ids[2]).tolist() == [*library_ids(bpe, "a b c"), 1]


def test_op9_on_the_table(spark, data):
    """A document counts as target if a label row says so; losses by plain counting."""
    texts = dict(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect())
    labels = spark.read.parquet(f"{data}/labels.parquet").collect()
    targets = {r["doc_id"] for r in labels if r["quality"] == 1 and r["toxic"] == 0}
    bpe = bpe_automaton.open_bpe(default_tokenizer_path())
    vocabulary = len(bpe.arc_labels)
    ids = {i: library_ids(bpe, t) for i, t in texts.items()}
    uni, bi = [Counter(), Counter()], [Counter(), Counter()]
    for i, x in ids.items():
        m = 0 if i in targets else 1
        uni[m].update(x)
        uni[m][vocabulary] += bool(x)
        bi[m].update(zip([vocabulary, *x], x))
    got = {r["doc_id"]: r for r in registry.queries()["op9_cross_entropy_difference"](spark, data).collect()}
    assert set(got) == set(texts)
    total = [sum(n for t, n in u.items() if t != vocabulary) for u in uni]
    for i in sorted(ids)[::7]:
        if ids[i]:
            loss = []
            own_uni, own_bi = Counter([vocabulary, *ids[i]]), Counter(zip([vocabulary, *ids[i]], ids[i]))
            for m in range(2):
                out = int(m == (0 if i in targets else 1))
                u, b = (lambda t: uni[m][t] - out * own_uni[t]), (lambda k: bi[m][k] - out * own_bi[k])  # noqa: B023
                n = total[m] - out * len(ids[i]) + vocabulary
                loss.append(-sum(math.log(0.7 * b((p, x)) / max(1, u(p)) + 0.3 * (u(x) + 1) / n) for p, x in zip([vocabulary, *ids[i]], ids[i])) / len(ids[i]))
            assert math.isclose(got[i]["score"], loss[0] - loss[1], rel_tol=1e-6, abs_tol=1e-9)
