"""Distances between sources against a count over all terms of all pairs."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb

from loomspark.llm import divergence, registry

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_force(rows, least, ranks):
    counts, groups, docs = defaultdict(Counter), set(), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = [t.translate(LOWER) for t in TERM.findall(text or "")]
        groups.add((lang, source))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        mine = [s for la, s in groups if la == lang]
        whole = sum((counts[lang, s] for s in mine), Counter())

        def shares(counter, kept=kept):
            total = sum(counter[t] for t in kept)
            return {t: 1 + 10**9 * (counter[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = shares(counts[lang, source]), shares(whole)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        pairs = []
        for other in mine:
            if other != source:
                r = shares(counts[lang, other])
                pairs.append((-sum(f(p[t], r[t]) for t in kept), other.encode(), other))
        terms = [(-f(p[t], q[t]), t.encode(), t) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
            out += [(lang, source, part, item, -value, rank) for rank, (value, _, item) in enumerate(found, 1)]
    return sorted(out)


def rows_of(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def test_audit_is_the_count_over_all_terms(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_TERMS", 20)
    rng = random.Random(6)
    words = [*"abcdefghij", "Été", "été", "漢字", "ſtraße", "I", "i", "x1y", "K", "😀", "ﬀ"]
    rows = []
    for i in range(400):
        source = rng.choice(["s1", "s2", "é", "z", "\U0001f600", None, "", "s1"])
        lang = rng.choice(["en", "fr", None, ""])
        rows.append((lang, source, " ".join(rng.choice(words[: 4 + 3 * (hash(source or "") % 5)]) for _ in range(rng.randint(0, 30)))))
    rows += [("en", "hot", "a b c " * 50)] * 200 + [("de", "no terms", "123 ... !"), ("de", "null", None), ("de", "rare", "einmal"), ("it", "alone", "uno " * 20)]
    rows += [("en", "empty", ""), ("en", "long", "abc déf " * 20_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, source string, text string, term string, n int").repartition(3)
    for least in (1, 3, 10):
        assert rows_of(divergence.audit(df, least=least)) == brute_force(rows, least, 10)
    assert rows_of(divergence.audit(df, ranks=2)) == brute_force(rows, 10, 2)


def test_odd_tables(spark):
    df = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit(df).count() == 0
    none = spark.createDataFrame([(None, None, None)] * 3, "lang string, source string, text string")
    assert divergence.audit(none).count() == 0
    rows = [("en", f"s{i % 2}", "a a b") for i in range(30)]
    names = spark.createDataFrame(rows, "p string, q string, zero string")
    assert rows_of(divergence.audit(names, lang="p", source="q", text="zero")) == brute_force(rows, 10, 10)


def test_op13_against_sql(spark, data):
    rows = rows_of(registry.queries()["op13_baseline_divergence"](spark, data))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    assert rows == sorted(con.execute(registry.oracle_sql()["op13_baseline_divergence"]).fetchall()) and {r[2] for r in rows} == {"pair", "term"}
    docs = [(r["lang"], r["source"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert rows == brute_force(docs, 10, 10)
