"""Near-duplicate classes with ProbMinHash signatures, banding and exact verification.

Words are the runs between white space, lower-cased, without punctuation; a document's
elements are its shingles of five words (of all its words, if fewer). A document has a
signature of unit weights, whose agreement follows the similarity that is verified; one that
repeats shingles has a second, with weights ``1 + ln(count)``, in the same buckets. Every element sends arrivals of a Poisson process whose rate is its weight
to random registers; a register keeps the first arrival, so two documents agree in a register
with probability equal to their probability Jaccard similarity. An element stops once its
next arrival is later than the latest register, usually after one or two arrivals.

1. Documents of equal word sequences form a group; one of them stands for it from here on.
2. Registers are banded; a bucket is a band with equal registers, of either signature.
3. Candidate links: to a bucket's leader, the member that shares large buckets most often,
   and all pairs in buckets of up to ``SMALL_BUCKET``. First each document's most frequent
   leader is verified, then only candidates whose ends are not connected yet.
4. Members of larger buckets that still hold several components are compared by an exact
   set-similarity join: sets of similarity 0.8 share one of their rarest fifth of shingles (in
   any common order), so documents meet by these, whatever they share besides.
5. Verified links (Jaccard similarity of the shingle sets of 0.8 or more) give components.

Nothing is capped, and no bucket, group or component is brought together in one task: tables of
one row a bucket are written before they are joined, so that adaptive execution can split a
bucket of many members, and larger groups of step 4 are a grid of blocks. ``SMALL_BUCKET``
decides by which of the steps a pair is found, not whether.

Defined cases: a null text, and a null id, is in no class but its own; texts without a word
are copies if equal; whole texts count at any length; repeated rows are members of one class;
rows of one id with different texts are documents of their own; of equally large classes and
leaders the smaller row number counts; ids may be of any type that has an order, and the class id
is the smallest document id of the class;
other columns of the input, whatever their names, play no part; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.bpe_automaton import rows_in_slices
from loomspark.llm.common import cut_lineage, free_names, frugal, read_table, small_batches

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 28, 5
SMALL_BUCKET = 8
#: Slots of the table of shingle counts that orders shingles in step 4, and rows of a block.
COUNT_BITS, BLOCK_ROWS = 18, 1000
#: Up to so many ids (8 bytes each) a set of documents is broadcast; beyond, it is joined.
BROADCAST_IDS = 1_000_000
#: Up to so many edges, both ways, components are found in so many partitions, with labels broadcast.
FEW_EDGES, FEW_PARTITIONS = 200_000, 8

_MARKS = re.compile(r"\W+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """White-space separated run -> 64-bit hash of its word (0 for none); bounded."""

    def __missing__(self, run: str) -> int:
        word = run if run.isalnum() else _MARKS.sub("", run)
        value = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little") | 1 if word else 0
        if len(run) <= 64:
            if len(self) >= 150_000:
                self.clear()
            self[run] = value
        return value


def word_hashes(text: str, known: WordHashes) -> np.ndarray:
    found = np.fromiter(map(known.__getitem__, text.lower().split()), np.uint64)
    return found[found != 0]


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """One hash for each position; of all words if there are fewer than ``size``."""
    size = min(size, len(words))
    if not size:
        return words
    n = len(words) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = mix(out * _ODD + words[k : n + k])
    return out


def signatures(elements: list[np.ndarray], weights: list[np.ndarray], registers: int) -> np.ndarray:
    """ProbMinHash of several weighted sets at once (row: set, column: register)."""
    sizes = [len(e) for e in elements]
    item = np.concatenate(elements) if elements else np.zeros(0, np.uint64)
    weight = np.concatenate(weights) if weights else np.zeros(0)
    owner = np.repeat(np.arange(len(elements)), sizes)
    first = np.full(len(elements) * registers, np.inf)
    winner = np.zeros(len(elements) * registers, np.uint64)
    time, step = np.zeros(len(item)), np.zeros(1, np.uint64)
    while len(item):
        step += _ODD
        bits = mix(item + step)
        time = time - np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        place = owner * registers + (mix(bits) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, place, time)
        won = first[place] == time
        winner[place[won]] = item[won]
        latest = first.reshape(-1, registers).max(axis=1)
        going = time < latest[owner]
        item, weight, owner, time = item[going], weight[going], owner[going], time[going]
    return winner.reshape(-1, registers)


def bucket_ids(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit id for each band of each row, of its number and its registers."""
    out = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(signature), bands)).copy()
    parts = signature.reshape(len(signature), bands, rows)
    for r in range(rows):
        out = mix(out * _ODD + parts[:, :, r])
    return out.view(np.int64)


def content_key(words: np.ndarray, text: str) -> np.ndarray:
    """Two longs that equal word sequences share, and equal texts without a word."""
    return np.frombuffer(hashlib.blake2b(words.tobytes() if len(words) else b"=" + text.encode(), digest_size=16).digest(), np.int64)


def signature_rows(docs: DataFrame, bands: int, rows: int, shingle: int) -> DataFrame:
    """doc_id, text_hash, content key (k1, k2) and buckets of each text (doc_id, text, text_hash)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for part in rows_in_slices(batch, 1, most_bytes=1 << 20, most_rows=2048):
                keys, elements, weights, owners = [], [], [], []
                for text in part.column(1).to_pylist():
                    words = word_hashes(text, known)
                    keys.append(content_key(words, text))
                    if len(words):
                        found, counts = np.unique(shingle_hashes(words, shingle), return_counts=True)
                        for weight in [np.ones(len(found)), 1.0 + np.log(counts)][: 1 + bool(counts.max() > 1)]:
                            owners.append(len(keys) - 1)
                            elements.append(found)
                            weights.append(weight)
                held: list[list[np.ndarray]] = [[] for _ in keys]
                for owner, ids in zip(owners, bucket_ids(signatures(elements, weights, bands * rows), bands, rows)):
                    held[owner].append(ids)
                both = np.array(keys)
                lists = pa.array([np.unique(np.concatenate(h)) if h else [] for h in held], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(both[:, 0]), pa.array(both[:, 1]), lists], ["doc_id", "text_hash", "k1", "k2", "buckets"])

    return small_batches(docs).mapInArrow(frugal(work), f"doc_id {kind}, text_hash long, k1 long, k2 long, buckets array<long>")


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """Content key and the set of shingle hashes of each text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for part in rows_in_slices(batch, 1, most_bytes=1 << 20, most_rows=2048):
                keys, sets = [], []
                for text in part.column(1).to_pylist():
                    words = word_hashes(text, known)
                    keys.append(content_key(words, text))
                    sets.append(np.unique(shingle_hashes(words, shingle)).view(np.int64))
                both = np.array(keys)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(sets, pa.list_(pa.int64()))], ["k1", "k2", "shingles"])

    return small_batches(docs).mapInArrow(frugal(work), "k1 long, k2 long, shingles array<long>")


def only(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose id is among ``ids`` (one column, distinct): by broadcast if few, else by a join."""
    few = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, column, "left_semi")


def alike(similarity: float) -> Column:
    """Whether the sets ``sa`` and ``sb`` have the similarity; sizes alone often decide."""
    small, large = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return (small >= similarity * large) & (common >= similarity * (F.size("sa") + F.size("sb") - common))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose shingle sets have the similarity."""
    left, right = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(left, "a").join(right, "b").where(alike(similarity)).select("a", "b")


def rare_shingles(members: DataFrame, similarity: float) -> DataFrame:
    """The shingles of each member (rep, label, shingles) by which it has to meet all members of
    the similarity: the rarest of its set, one more than a similar set can lack.

    Counts go by slots of a table of fixed size; they only order shingles, and any order that
    all members share gives the same pairs.
    """
    slots = F.shiftrightunsigned(F.col("s"), 64 - COUNT_BITS).cast("int")
    held = members.select(F.explode("shingles").alias("s")).groupBy(slots.alias("slot")).agg(F.count(F.lit(1)).alias("n")).collect()
    counts = np.zeros(1 << COUNT_BITS, np.int64)
    counts[[r["slot"] for r in held]] = [r["n"] for r in held]
    shared = members.sparkSession.sparkContext.broadcast(counts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            for part in rows_in_slices(batch, 2, most_bytes=1 << 20, most_rows=2048):
                found = []
                for shingles in part.column(2):
                    s = shingles.values.to_numpy()
                    order = np.lexsort((s, counts[s.view(np.uint64) >> np.uint64(64 - COUNT_BITS)]))
                    found.append(s[order[: len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1]])
                sizes = pc.list_value_length(part.column(2))
                at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                places = np.concatenate([np.zeros(0, np.int32), *(np.arange(len(f), dtype=np.int32) for f in found)])
                columns = [part.column(0).take(at), part.column(1).take(at), sizes.take(at), pa.array(places), pa.array(np.concatenate([np.zeros(0, np.int64), *found]))]
                yield pa.RecordBatch.from_arrays(columns, ["rep", "label", "size", "place", "s"])

    return small_batches(members).select("rep", "label", "shingles").mapInArrow(frugal(work), "rep long, label long, size int, place int, s long")


def crossing_pairs(open_members: DataFrame, similarity: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs (a, b) of members of different components that may have the similarity.

    Of the members that share a rare shingle, those outside the most frequent component meet all
    others; groups of many members are cut into blocks on both sides. A pair is let through if
    the shingles behind the shared one, in the common order, are enough for the similarity: for
    the first one that two sets share this bounds what they have in common.
    """
    rare = cut_lineage(rare_shingles(open_members, similarity))
    sizes = rare.groupBy("s", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("s").agg(F.max(F.struct("n", "label")).alias("m"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("all"))
    several = cut_lineage(sizes.where("parts > 1").select("s", F.col("m.label").alias("main"), F.ceil(F.col("all") / block_rows).cast("int").alias("blocks")))
    met = rare.join(several, "s")
    block, every = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = met.where("label <> main").select("s", block.alias("i"), every.alias("j"), F.col("rep").alias("a"), F.col("label").alias("la"), F.col("size").alias("na"), F.col("place").alias("pa"))
    right = met.select("s", block.alias("j"), every.alias("i"), F.col("rep").alias("b"), F.col("label").alias("lb"), F.col("size").alias("nb"), F.col("place").alias("pb"))
    most = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    fits = (F.col("la") != F.col("lb")) & (most >= similarity / (1 + similarity) * (F.col("na") + F.col("nb")) - 1e-9)
    return left.join(right, ["s", "i", "j"]).where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and the smallest node of its component, by label spreading with shortcuts.

    A round is one aggregation. Few edges take few tasks, however many partitions a shuffle has: the
    driver keeps a record of every task, and there are rounds for each of several tables of links.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    few = both.count() <= FEW_EDGES
    gathered = lambda df: df.coalesce(FEW_PARTITIONS) if few else df
    both = gathered(both)
    labels = cut_lineage(gathered(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label"))))
    while True:
        known = F.broadcast(labels) if few else labels
        told = both.join(known.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), F.col("label").alias("new"), F.lit(None).alias("label"))
        # A label is itself a node, whose own label is at most as large.
        far = labels.join(known.select(F.col("node").alias("label"), F.col("label").alias("new")), "label").select("node", "new", "label")
        moved = cut_lineage(gathered(told.union(far).groupBy("node").agg(F.max("label").alias("label"), F.min("new").alias("new"))))
        labels = moved.select("node", F.col("new").alias("label"))
        if moved.where("new < label").isEmpty():
            return labels


def unconnected(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    a, b = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    return pairs.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def classified(docs: DataFrame, doc_id: str, text: str, similarity: float, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash and class (a number) of every row with an id and a text."""
    texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"))
    usable = texts.where("doc_id is not null and text is not null")
    signed = cut_lineage(signature_rows(usable, bands, rows, shingle).withColumn("row", F.monotonically_increasing_id()))
    groups = signed.groupBy("k1", "k2").agg(F.min("row").alias("rep"))
    stands = signed.join(groups.select(F.col("rep").alias("row")), "row", "left_semi")
    placed = stands.select(F.col("row").alias("rep"), F.explode("buckets").alias("bucket"))
    # Written tables of one row a bucket: a join with a table under aggregation could not be split.
    buckets = cut_lineage(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = cut_lineage(placed.join(buckets, "bucket"))

    # Who shares large buckets most often is likely what the others were copied from.
    centrality = members.groupBy("rep").agg(F.sum("n").alias("score"))
    leaders = cut_lineage(members.join(centrality, "rep").groupBy("bucket").agg(F.max(F.struct("score", (-F.col("rep")).alias("first"))).alias("m")))
    led = members.join(leaders.select("bucket", (-F.col("m.first")).alias("leader")), "bucket").where("rep <> leader")
    star = led.groupBy("leader", "rep").agg(F.count(F.lit(1)).alias("n"))
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    best = star.groupBy("rep").agg(F.max(F.struct("n", "leader")).alias("m")).select(*ordered(F.col("rep"), F.col("m.leader"))).distinct()
    small = members.where(F.col("n") <= SMALL_BUCKET).select("bucket", "rep")
    close = small.select("bucket", F.col("rep").alias("a")).join(small.select("bucket", F.col("rep").alias("b")), "bucket").where("a < b").select("a", "b")
    best = cut_lineage(best)
    candidates = star.select(*ordered(F.col("leader"), F.col("rep"))).union(close).distinct().join(best, ["a", "b"], "left_anti")

    wanted = cut_lineage(signed.join(members.select(F.col("rep").alias("row")).distinct(), "row").select("doc_id", "k1", "k2", F.col("row").alias("rep")))
    sets = shingle_sets(only(usable, wanted.select("doc_id").distinct(), "doc_id"), shingle)
    sets = cut_lineage(sets.join(wanted.drop("doc_id"), ["k1", "k2"]).select("rep", "shingles"))
    if sets.count() > wanted.count():
        sets = cut_lineage(sets.dropDuplicates(["rep"]))
    links = cut_lineage(verified(best, sets, similarity))
    labels = components(links)
    more = cut_lineage(verified(unconnected(candidates, labels), sets, similarity))
    if not more.isEmpty():
        links = links.union(more)
        labels = components(links)

    # Larger buckets that still hold several components.
    large = members.where(F.col("n") > SMALL_BUCKET).select("bucket", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    parts = cut_lineage(large.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket"))
    open_members = cut_lineage(large.join(parts, "bucket").select("rep", "label").distinct())
    if not open_members.isEmpty():
        pairs = crossing_pairs(open_members.join(sets, "rep"), similarity)
        more = cut_lineage(verified(pairs, sets, similarity))
        if not more.isEmpty():
            labels = components(links.union(more))

    groups = groups.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.coalesce("label", "rep").alias("class"))
    return signed.select("doc_id", "text_hash", "k1", "k2").join(groups, ["k1", "k2"]).select("doc_id", "text_hash", "class")


def near_duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row a document: doc_id and class_id, the smallest id of its class."""
    found = cut_lineage(classified(docs, doc_id, text, similarity, shingle, bands, rows))
    firsts = cut_lineage(found.groupBy("class").agg(F.min("doc_id").alias("class_id")))
    alone = docs.where(F.col(f"`{doc_id}`").isNull() | F.col(f"`{text}`").isNull()).select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{doc_id}`").alias("class_id"))
    return found.join(firsts, "class").select("doc_id", "class_id").unionByName(alone)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, that of the smallest id; of several texts under that id the
    one of the smallest hash, of repeated rows one. Rows without id or text stay."""
    found = cut_lineage(classified(docs, doc_id, text, SIMILARITY, SHINGLE, BANDS, ROWS))
    firsts = cut_lineage(found.groupBy("class").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")))
    others = found.join(firsts, "class").where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("text_hash") != F.col("first.text_hash")))
    gone = cut_lineage(others.select("doc_id", "text_hash").distinct())
    key, content = free_names(docs, 2)
    rows = docs.withColumns({key: F.col(f"`{doc_id}`"), content: F.xxhash64(F.col(f"`{text}`"))})
    gone, few = gone.select(F.col("doc_id").alias(key), F.col("text_hash").alias(content)), gone.count() <= BROADCAST_IDS
    kept = rows.join(F.broadcast(gone) if few else gone, [key, content], "left_anti")
    if not found.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        whole = F.col(key).isNotNull() & F.col(f"`{text}`").isNotNull()
        kept = kept.where(whole).dropDuplicates([key, content]).unionByName(kept.where(~whole))
    return kept.drop(key, content).select(*[f"`{c}`" for c in docs.columns])


def op3_probminhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(read_table(spark, sf_dir, "documents"))
