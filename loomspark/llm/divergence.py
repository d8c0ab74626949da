"""How far the sources of a language are from each other, and the terms that set each apart.

Every source has a smoothed share for each term kept for its language, and the distance of two
sources is the sum, over all these terms, of ``f = (p - q)**2 / (p + q)``. Most terms are absent
from most sources, and all absent terms of a source have one share. So a pair of sources starts
from its baseline, the number of terms times f of two zero counts, and an inverted index (the
terms of a language, each with the sources that have it) gives corrections only where a count
is not zero:

* for a term that the first source has, the difference that its count makes while the other's
  is zero. It depends on the share alone, so terms of one share are one row a pair, and the
  number of such rows follows the different counts and not the terms;
* for a term that both have, what is left to the true value. Only these corrections come from
  pairs within a posting list, and a list has no more pairs than its language has in the result.

Texts are counted in Python, slice by slice, and come out as one row a (language, source, term),
so frequent terms and sources are small before anything is shuffled. Terms are ranked by windows.
All arithmetic is in whole numbers.

Defined cases: a null text, language or source counts as empty; a group whose texts hold no
term takes part, and so does one whose language keeps no term (all its distances are 0, no term
is ranked); texts of any length are counted whole; repeated rows are documents of their own;
ties go to the smaller item by its UTF-8 bytes; a source alone in its language has no pairs; an
empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.llm.common import cut_lineage, frugal, read_table, small_batches

#: Documents of a language that a kept term occurs in, ranks given for terms, parts of a share.
LEAST_DOCUMENTS, TERM_RANKS, PARTS = 10, 10, 1_000_000_000
#: Distinct terms that a task holds before it passes its counts on.
HELD_TERMS = 250_000
#: What ends a term becomes a space; of the rest only A to Z are changed.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
COUNTED = "lang string, source string, term string, n bigint, docs bigint"


def terms_of(text: str) -> list[bytes]:
    """Runs of letters of ASCII and of anything beyond it; A to Z are lower-cased."""
    return text.encode().translate(TERM_BYTES).split()


def counted(df: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) once for each that occurs; an empty term counts documents alone."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows() -> pa.RecordBatch:
            columns: list[list] = [[], [], [], [], []]
            for (lang, source), (n, docs) in groups.items():
                columns[0] += [lang] * len(docs)
                columns[1] += [source] * len(docs)
                columns[2] += [t.decode() for t in docs]
                columns[3] += [n[t] for t in docs]
                columns[4] += docs.values()
            groups.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 3 + [pa.int64()] * 2)], ["lang", "source", "term", "n", "docs"])

        held = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                found = Counter(terms_of(text))
                before = len(docs)
                n.update(found)
                docs.update(found.keys())
                docs[b""] += 1
                held += len(docs) - before
                if held > HELD_TERMS:
                    yield rows()
                    held = 0
        yield rows()

    texts = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = small_batches(texts).mapInArrow(frugal(work), COUNTED)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str) -> Column:
    """The smoothed share in parts of PARTS, plus one; null if no term is kept. The product may
    pass 64 bits, so it is decimal."""
    return F.expr(f"1 + cast(cast({PARTS} as decimal(10, 0)) * ({count} + 2) div nullif({total} + 2 * v, 0) as bigint)")


def apart(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST_DOCUMENTS, ranks: int = TERM_RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the other sources of the language
    (part ``pair``) and the terms that a source has above its language (part ``term``)."""
    counts = counted(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))]))
    # A window holds one row a source; rare terms, which are most of them, are dropped before anything is written.
    whole = Window.partitionBy("lang", "term")
    rated = counts.withColumns({"lang_n": F.sum("n").over(whole), "lang_docs": F.sum("docs").over(whole)})
    held = cut_lineage(rated.where((F.col("term") == "") | (F.col("lang_docs") >= least)).drop("docs", "lang_docs"))
    postings = held.where("term <> ''")
    langs = postings.dropDuplicates(["lang", "term"]).groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    sizes = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = held.where("term = ''").select("lang", "source").join(langs, "lang", "left").join(sizes, ["lang", "source"], "left")
    groups = cut_lineage(groups.select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("lang_total", F.lit(0)).alias("lang_total")).withColumn("zero", share("0", "total")))
    shares = cut_lineage(postings.join(groups, ["lang", "source"]).select("lang", "source", "term", share("n", "total").alias("p"), share("lang_n", "lang_total").alias("q"), "zero"))

    others = groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("other_zero"), "v")
    pair = (F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"))
    baseline = groups.drop("v").join(others, "lang").where("source < other").select("lang", *pair, F.coalesce(F.col("v") * apart("zero", "other_zero"), F.lit(0)).alias("value"))
    levels = shares.groupBy("lang", "source", "p", "zero").agg(F.count(F.lit(1)).alias("m"))
    single = levels.join(others, "lang").where("source <> other").select("lang", *pair, (F.col("m") * (apart("p", "other_zero") - apart("zero", "other_zero"))).alias("value"))
    right = shares.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("other_p"), F.col("zero").alias("other_zero"))
    left_over = apart("p", "other_p") - apart("p", "other_zero") - apart("zero", "other_p") + apart("zero", "other_zero")
    double = shares.join(right, ["lang", "term"]).where("source < other").select("lang", *pair, left_over.alias("value"))
    sums = baseline.unionAll(single).unionAll(double).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = sums.select("lang", ends.alias("e"), "value").select("lang", "e.source", "e.item", "value")

    above = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), apart("p", "q").alias("value"))
    return ranked(pairs, "pair").unionAll(ranked(above, "term").where(F.col("rank") <= ranks))


def op13_baseline_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and the terms that set each source apart."""
    return audit(read_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT i) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 10),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
a AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
t AS (SELECT lang, source, sum(n) AS total FROM a GROUP BY ALL),
p AS (SELECT a.lang, a.source, a.term, a.n,
  1 + CAST((CAST(1000000000 AS HUGEINT) * (a.n + 2)) // (t.total + 2 * l.v) AS BIGINT) AS p,
  1 + CAST((CAST(1000000000 AS HUGEINT) * (a.lang_n + 2)) // (l.total + 2 * l.v) AS BIGINT) AS q
  FROM a JOIN t USING (lang, source) JOIN l USING (lang)),
s AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
r AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
    LEFT JOIN s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source
  UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 10
"""
