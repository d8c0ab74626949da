"""Secret scans with pattern rules and sliding-window entropy (DataFrame code only).

Three base rules give their leftmost non-overlapping matches. The entropy rule adds spans:
candidate strings are runs of at least ``MIN_RUN`` characters of the base64 alphabet that
hold letters and digits; a window of ``WINDOW`` characters slides over each, keeping counts
of the characters in it and the sum of ``n log2 n`` over the counts, both changed by one
removal and one addition a step. The window's Shannon entropy is ``log2 W - sum / W``. A
candidate counts if its largest entropy reaches the threshold of its character class (hex
digits, digits and letters of one case, or the whole alphabet), unless the allow-list knows it or base spans cover all of it.

Positions are code points, end exclusive. Defined cases: a null or empty text has no spans;
texts of any length are scanned whole; rows are scanned independently, so repeated rows and
ties need nothing special; all other columns stay, whatever their names, but one named like the
new column is replaced; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import free_names, read_table

#: The base rules and their least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_VALUE_AT_LEAST = 8
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
MIN_RUN = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Least entropy of a window by character class. Of uniformly random strings of one window (20
#: characters), simulated, it is 3.36 bits on average for hex digits (1 % are below 2.90), 3.84
#: for digits and letters of one case (3.40) and 4.03 for base62 and base64 (3.65).
CLASS_BITS = (("^[0-9a-fA-F]+$", 2.9), ("^([0-9a-z]+|[0-9A-Z]+)$", 3.38), ("", 3.64))
#: Well-known harmless strings: placeholders, UUIDs, and words, which are in lower case (or
#: capitalized) and have no six consonants in a row, joined by marks, with up to four digits.
ALLOWED = (
    r"(?i:example|placeholder|dummy|changeme)"
    r"|^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
    r"|^(?!.*[b-df-hj-np-tv-xz]{6})[/_=-]*[A-Z]?[a-z]+([/_=-]+[A-Z]?[a-z]+)*[/_=-]*[0-9]{0,4}$"
)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, value).

    The text between matches gives the starts: a fold over both lists adds up lengths.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("value"))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        return F.struct(
            F.coalesce(end, state["at"]).alias("at"),
            F.when(x["value"].isNull(), state["spans"]).otherwise(F.concat(state["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))))).alias("spans"),
        )

    return F.aggregate(both, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda s: s["spans"])


def largest_entropy(value: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits, of the windows of a string, by incremental counts."""
    places = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))

    def part(n: Column) -> Column:
        return F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))

    def step(state: Column, i: Column) -> Column:
        counts = state["counts"]
        new = state["places"][i]
        old = F.when(i >= window, state["places"][F.greatest(i - window, F.lit(0))]).otherwise(F.lit(0))
        changed = F.transform(counts, lambda n, k: n + F.when(k == new, 1).otherwise(0) - F.when((k == old) & (old > 0), 1).otherwise(0))
        gone = F.when(old > 0, part(counts[old] - 1) - part(counts[old])).otherwise(F.lit(0.0))
        there = counts[new] - F.when(old == new, 1).otherwise(0)
        total = state["total"] + gone + part(there + 1) - part(there)
        bits = F.log2(F.lit(float(window))) - total / F.lit(float(window))
        return F.struct(
            state["places"].alias("places"),
            changed.alias("counts"),
            total.alias("total"),
            F.when(i >= window - 1, F.greatest(state["best"], bits)).otherwise(state["best"]).alias("best"),
        )

    start = F.struct(places.alias("places"), F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
    return F.aggregate(F.sequence(F.lit(0), F.length(value) - 1), start, step, lambda s: s["best"])


def kind_spans(found: Column, kind: str) -> Column:
    order = KINDS.index(kind)
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def scan(df: DataFrame, text: str = "text", spans: str = "secrets") -> DataFrame:
    """Add ``spans``: an array of (start, order, end, kind), by start, then rule."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    value = F.lit(ASSIGN)
    assigned = F.filter(matches(t, ASSIGN), lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 2)) >= ASSIGN_VALUE_AT_LEAST)
    runs = F.filter(matches(t, RUN), lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]") & ~m["value"].rlike(ALLOWED))

    def limit(value: Column) -> Column:
        out = F.lit(CLASS_BITS[-1][1])
        for pattern, bits in reversed(CLASS_BITS[:-1]):
            out = F.when(value.rlike(pattern), bits).otherwise(out)
        return out

    assign, access, hexes, held_runs, held = free_names(df, 5, spans)
    rows = df.withColumns(
        {
            assign: F.when(F.regexp_like(t, value), assigned).otherwise(none),
            access: F.when(F.contains(t, F.lit("AKIA")), matches(t, ACCESS)).otherwise(none),
            hexes: F.when(t.rlike(HEX), matches(t, HEX)).otherwise(none),
            held_runs: F.when(t.rlike(RUN), runs).otherwise(none),
        }
    )
    base = F.array_sort(F.concat(*(kind_spans(F.col(c), k) for c, k in zip((assign, access, hexes), KINDS))))
    rows = rows.withColumn(held, base)
    # How far base spans, which are in order, cover a run from its start without a gap.
    reach = lambda r: F.aggregate(held, r["start"], lambda at, b: F.when(b["start"] <= at, F.greatest(at, b["end"])).otherwise(at))
    open_runs = F.filter(held_runs, lambda r: reach(r) < r["end"])
    high = F.filter(open_runs, lambda r: largest_entropy(r["value"]) >= limit(r["value"]))
    rows = rows.withColumn(spans, F.when(F.size(held_runs) == 0, F.col(held)).otherwise(F.array_sort(F.concat(held, kind_spans(high, "entropy")))))
    return rows.drop(assign, access, hexes, held_runs, held)


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Put ``mark`` in the place of every secret; overlapping spans become one."""

    (held,) = free_names(df, 1)
    given = F.col(f"`{text}`")

    def step(state: Column, s: Column) -> Column:
        inside = s["start"] < state["at"]
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(inside, state["parts"]).otherwise(F.concat(state["parts"], F.array(F.substring(given, state["at"] + 1, s["start"] - state["at"]), F.lit(mark)))).alias("parts"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    cut = F.aggregate(held, start, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(given, s["at"] + 1, F.length(given))))
    rows = scan(df, text, held)
    return rows.withColumn(text, F.when(F.size(held) > 0, cut).otherwise(given)).drop(held)


def op10_entropy_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    base = F.filter("secrets", lambda s: s["kind"] != "entropy")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs).select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("secrets")).alias("spans"))
