"""Cross-entropy difference of matched target and background n-gram models.

Both models are interpolated bigram models over one vocabulary, the ids of a public BPE
tokenizer, with the same smoothing; they differ only in the documents counted. Every distinct
pair of neighbouring tokens has counters of its own, so a model grows with its corpus.

1. Texts are encoded once, in blocks of about ``BLOCK_TOKENS`` tokens.
2. Each block sends its distinct pairs with their counts; summed by pair, they are the model.
3. The model is joined to the pairs of each block, and a block's documents are scored with the
   counts of the block's own pairs. No task holds more of the model than one block asks for.
   A document's own counts are taken out of the model that counted it, so it is scored by the
   others only (by its copies, too).

Only counts of single tokens, bounded by the vocabulary, reach the driver.

A document's score is the mean over its tokens of its target loss less its background loss,
in nats: negative for text that is more like the target.

Defined cases: null and empty texts have no token and null losses; a document counts as
target if any of its label rows does; without target documents the target model is the
smoothing alone; repeated rows count as often as they occur, each scored by the others, so
equal texts of one model have equal scores; whole texts are scored; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.bpe_automaton import open_bpe, published, rows_in_slices
from loomspark.llm.common import cut_lineage, default_tokenizer_path, frugal, read_table, small_batches, written
from loomspark.llm.near_duplicates import BROADCAST_IDS

#: Tokens after which a block ends; only a longer text makes a longer block.
BLOCK_TOKENS = 2_000_000
BIGRAM_WEIGHT = 0.7


def pair_keys(previous: np.ndarray, token: np.ndarray, vocabulary: int) -> np.ndarray:
    """One number for each pair; ``vocabulary`` stands for the start of a text."""
    return previous * (vocabulary + 1) + token


def id_type(vocabulary: int) -> type:
    return np.uint16 if vocabulary <= 1 << 16 else np.uint32


def token_arrays(packed: list[bytes], vocabulary: int, width: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens of several texts, what stands before each (``vocabulary`` at a start), sizes."""
    sizes = np.array([len(p) // np.dtype(width).itemsize for p in packed], np.int64)
    token = np.frombuffer(b"".join(packed), width).astype(np.int64)
    previous = np.empty_like(token)
    previous[1:] = token[:-1]
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    previous[starts] = vocabulary
    return token, previous, sizes


def counts_within(owner: np.ndarray, value: np.ndarray, values: int) -> np.ndarray:
    """How often each value occurs in the text of its place."""
    _, at, counts = np.unique(owner * values + value, return_inverse=True, return_counts=True)
    return counts[at]


class TokenCounts:
    """Counts of single tokens in both models: row 0 target, row 1 background."""

    def __init__(self, vocabulary: int, unigrams: np.ndarray, starts: np.ndarray):
        self.vocabulary = vocabulary
        self.contexts = np.concatenate([unigrams, starts[:, None]], axis=1).astype(np.float64)
        self.totals = unigrams.sum(axis=1).astype(np.float64)

    def losses(self, token: np.ndarray, previous: np.ndarray, sizes: np.ndarray, pairs: list[np.ndarray], target: np.ndarray) -> np.ndarray:
        """The loss of every token of several texts under both models, given the counts of its
        pair in each; what a text itself adds to a model's counts is left out."""
        owner = np.repeat(np.arange(len(sizes)), sizes)
        own_pair = counts_within(owner, pair_keys(previous, token, self.vocabulary), (self.vocabulary + 1) ** 2)
        own_token = counts_within(owner, token, self.vocabulary)
        own_context = np.empty_like(own_token)
        own_context[1:] = own_token[:-1]
        own_context[previous == self.vocabulary] = 1
        out = np.empty((2, len(token)))
        for m in range(2):
            mine = np.repeat(target if m == 0 else ~target, sizes)
            share = (pairs[m] - mine * own_pair) / np.maximum(self.contexts[m].take(previous) - mine * own_context, 1.0)
            single = (self.contexts[m].take(token) - mine * own_token + 1.0) / (self.totals[m] - mine * np.repeat(sizes, sizes) + self.vocabulary)
            out[m] = -np.log(BIGRAM_WEIGHT * share + (1 - BIGRAM_WEIGHT) * single)
        return out


def encoded(docs: DataFrame, path: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, target, block and the packed ids of the whole text, in as few bytes an id as
    the vocabulary needs, of rows (doc_id, target, text)."""
    kind = dict(docs.dtypes)["doc_id"]
    shared = published(docs.sparkSession, path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value
        width = id_type(len(bpe.arc_labels))
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part in rows_in_slices(batch, 2):
                packed, blocks = [], []
                for ids in bpe.encode_column(part.column(2)):
                    if held >= block_tokens:
                        block, held = block + 1, 0
                    packed.append(np.frombuffer(ids, np.uint32).astype(width).tobytes())
                    blocks.append(block)
                    held += len(ids) // 4
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(blocks, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "target", "block", "ids"])

    return small_batches(docs).select("doc_id", "target", "text").mapInArrow(frugal(work), f"doc_id {kind}, target boolean, block long, ids binary")


def counted(rows: DataFrame, vocabulary: int) -> DataFrame:
    """block, pair and its counts (target, background) of rows whose blocks stand together."""
    width = id_type(vocabulary)

    def summed(block: int, found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, counts = (np.concatenate(x) for x in zip(*found))
        keys, at = np.unique(keys, return_inverse=True)
        both = [np.bincount(at, counts[:, m], len(keys)).astype(np.int64) for m in range(2)]
        for i in range(0, len(keys), 1 << 16):
            s = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[s]), block)), *(pa.array(x[s]) for x in (keys, *both))], ["block", "pair", "target", "background"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, found = None, []
        for batch in batches:
            for part in rows_in_slices(batch, 2, most_bytes=1 << 20):
                blocks, flags, packed = np.array(part.column(0)), np.array(part.column(1).to_pylist(), bool), part.column(2).to_pylist()
                for block in np.unique(blocks).tolist():
                    if block != current and found:
                        yield from summed(current, found)
                        found = []
                    current = block
                    mine = np.flatnonzero(blocks == block)
                    token, previous, sizes = token_arrays([packed[i] for i in mine], vocabulary, width)
                    keys, at = np.unique(pair_keys(previous, token, vocabulary), return_inverse=True)
                    target = np.bincount(at, np.repeat(flags[mine], sizes), len(keys))
                    found.append((keys, np.stack([target, np.bincount(at, minlength=len(keys)) - target], axis=1)))
        if found:
            yield from summed(current, found)

    return small_batches(rows).select("block", "target", "ids").mapInArrow(frugal(work), "block long, pair long, target long, background long")


def fit(pairs: DataFrame, vocabulary: int) -> tuple[DataFrame, TokenCounts]:
    """The model of all pairs (pair, target, background), and the counts of single tokens."""
    sums = [F.sum(m).alias(m) for m in ("target", "background")]
    model = pairs.groupBy("pair").agg(*sums)
    start = F.col("pair") >= vocabulary * (vocabulary + 1)
    # One row a token of the vocabulary, and one for the starts.
    token = (F.col("pair") % (vocabulary + 1)).cast("int").alias("token")
    table = pairs.groupBy(token).agg(*sums, *(F.sum(F.when(start, F.col(m)).otherwise(0)).alias(f"{m}_starts") for m in ("target", "background"))).toPandas()
    unigrams, starts = np.zeros((2, vocabulary), np.int64), np.zeros(2, np.int64)
    for m, name in enumerate(("target", "background")):
        unigrams[m, table["token"].to_numpy(np.int64)] = table[name].to_numpy(np.int64)
        starts[m] = table[f"{name}_starts"].sum()
    return model, TokenCounts(vocabulary, unigrams, starts)


def score(rows: DataFrame, pairs: DataFrame, model: DataFrame, tokens: TokenCounts) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score (losses a token, in nats)."""
    shared = rows.sparkSession.sparkContext.broadcast(tokens)
    kind, width = dict(rows.dtypes)["doc_id"], id_type(tokens.vocabulary)
    names = ["doc_id", "n_tokens", "target_loss", "background_loss", "score"]

    def work(texts: pa.Table, known: pa.Table) -> pa.Table:
        tokens = shared.value
        keys = known.column("pair").to_numpy()
        order = np.argsort(keys)
        keys = keys[order]
        counts = [known.column(m).to_numpy()[order] for m in ("target", "background")]
        done = []
        for batch in texts.select(["doc_id", "ids", "target"]).to_batches():
            for part in rows_in_slices(batch, 1, most_bytes=1 << 19):
                token, previous, sizes = token_arrays(part.column(1).to_pylist(), tokens.vocabulary, width)
                at = np.searchsorted(keys, pair_keys(previous, token, tokens.vocabulary))
                mine = tokens.losses(token, previous, sizes, [c[at] for c in counts], np.array(part.column(2).to_pylist(), bool))
                sums = np.concatenate([np.zeros((2, 1)), np.cumsum(mine, axis=1)], axis=1)
                ends = np.cumsum(sizes)
                means = (sums[:, ends] - sums[:, ends - sizes]) / np.maximum(sizes, 1)
                none = sizes == 0
                columns = [pa.array(x, pa.float64(), mask=none) for x in (means[0], means[1], means[0] - means[1])]
                done.append(pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), *columns], names))
        return pa.Table.from_batches(done)

    asked = pairs.select("block", "pair").join(model, "pair")
    texts = rows.select("doc_id", "block", "ids", "target")
    schema = f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, score double"
    return texts.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(work, schema)


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Encode all texts once, fit both models on them and score every document.

    ``targets`` holds the ids of target documents: few are broadcast, more are joined.
    """
    path = tokenizer or default_tokenizer_path()
    vocabulary = len(open_bpe(path).arc_labels)
    flags = targets.select("doc_id").where("doc_id is not null").distinct().withColumn("__target", F.lit(True))
    few = flags.count() <= BROADCAST_IDS
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(flags) if few else flags, "doc_id", "left")
    rows = cut_lineage(encoded(texts.select("doc_id", F.coalesce("__target", F.lit(False)).alias("target"), "text"), path, block_tokens))
    pairs = written(counted(rows, vocabulary), "pairs")
    return score(rows, pairs, *fit(pairs, vocabulary))


def op9_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = read_table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return cross_entropy_difference(read_table(spark, sf_dir, "documents"), targets)
