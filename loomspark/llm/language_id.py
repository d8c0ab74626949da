"""Language identification with a byte-level convolutional network.

Filters of width 2, 3 and 4 slide over byte classes; each filter's largest response in a
window of ``WINDOW`` bytes goes through a linear layer and softmax. The network is trained in
numpy on windows of a bounded sample of labelled documents and applied to all windows of
every text: a text's scores are the mean of its windows' probabilities, weighted by bytes.

As inputs are classes, a filter is a sum of table rows, one a byte. For prediction the rows
of neighbouring bytes are added in advance (one table over pairs), so a byte costs three
look-ups for all filters.

Defined cases: a null text or one without a letter is ``und`` with score 0; texts are read
whole at any length; without any labelled row every text is ``und``; ties go to the language
first in alphabetical order; repeated rows get equal predictions; other columns are kept, whatever their names, but those named
like the new ones are replaced; an empty table gives no rows.
A model that was fitted with ``other`` gives ``und`` to texts that no learned language fits too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.llm.bpe_automaton import rows_in_slices
from loomspark.llm.common import frugal, free_names, give_back, read_table, small_batches, unit_hash

WINDOW = 256
CLASSES = 64
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Bound of the training sample: documents expected of each language.
SAMPLE_PER_LANGUAGE = 800
UNKNOWN = "und"
CHUNK = 1 << 16
#: Part of the labelled windows held out that may be taken for no language.
HELD_OUT_REJECTED = 0.005
#: First letter and number of letters: Greek, Cyrillic, Hebrew, Arabic, Devanagari, kana, Han, Hangul.
OTHER_SCRIPTS = ((0x3B1, 25), (0x430, 32), (0x5D0, 27), (0x628, 35), (0x905, 53), (0x3041, 86), (0x4E00, 2000), (0xAC00, 2000))


@dataclass
class ByteCnn:
    """Weights: per width a table for each position (CLASSES x FILTERS), and the top layer."""

    languages: list[str]
    classes: np.ndarray
    tables: dict[int, np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def compiled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tables over pairs of classes for the first two bytes, and for what follows."""
        first = [(t[0][:, None] + t[1][None]).reshape(-1, FILTERS) for t in self.tables.values()]
        four = self.tables[4]
        return np.ascontiguousarray(np.concatenate(first, axis=1)), self.tables[3][2].copy(), np.ascontiguousarray((four[2][:, None] + four[3][None]).reshape(-1, FILTERS))

    def windows(self, stream: np.ndarray) -> np.ndarray:
        """Probabilities of each window of a stream of byte classes (a multiple of WINDOW).

        What stands behind a window is none of its business, as in training: it sees zeros.
        """
        pairs, third, last = self.compiled()
        rows = stream.reshape(-1, WINDOW)
        out = np.empty((len(rows), len(self.languages)), np.float32)
        for at in range(0, len(rows), CHUNK // WINDOW):
            part = np.zeros((len(rows[at : at + CHUNK // WINDOW]), WINDOW + 4), np.intp)
            part[:, :WINDOW] = rows[at : at + CHUNK // WINDOW]
            pair = part[:, :-1] * CLASSES + part[:, 1:]
            response = pairs.take(pair[:, :WINDOW], axis=0)
            response[:, :, FILTERS : 2 * FILTERS] += third.take(part[:, 2 : WINDOW + 2], axis=0)
            response[:, :, 2 * FILTERS :] += last.take(pair[:, 2 : WINDOW + 2], axis=0)
            pooled = np.maximum(response.max(axis=1) + self.bias, 0)
            out[at : at + len(part)] = softmax(pooled @ self.dense + self.offset)
        return out

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        sizes = np.array([len(t) for t in texts], np.int64)
        counts = np.maximum(1, -(-sizes // WINDOW))
        ends = np.cumsum(counts)
        stream = np.zeros(int(ends[-1]) * WINDOW, np.uint8)
        weights = np.full(int(ends[-1]), float(WINDOW))
        for text, size, count, end in zip(texts, sizes, counts, ends):
            begin = (end - count) * WINDOW
            stream[begin : begin + size] = self.classes[np.frombuffer(text, np.uint8)]
            weights[end - 1] = max(1, size - (count - 1) * WINDOW)
        total = np.add.reduceat(self.windows(stream) * weights[:, None], ends - counts, axis=0)
        share = total / np.add.reduceat(weights, ends - counts)[:, None]
        best = share.argmax(axis=1)
        return [self.languages[i] for i in best], np.clip(share[np.arange(len(best)), best], 0.0, 1.0).astype(np.float64)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def folded_bytes() -> np.ndarray:
    """Bytes with ASCII letters in lower case, digits as one and white space as one."""
    fold = np.arange(256)
    fold[65:91] += 32
    fold[48:58] = 48
    fold[[9, 10, 11, 12, 13]] = 32
    return fold


def train(texts: list[bytes], labels: list[str], epochs: int = 8, least_steps: int = 200, rate: float = 0.01, batch: int = 128, seed: int = 7) -> ByteCnn:
    """Fit the network on windows (the first WINDOW bytes of each given text).

    Small samples are gone through more often, for at least ``least_steps`` steps.
    """
    epochs = max(epochs, -(-least_steps // -(-len(texts) // batch)))
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    fold = folded_bytes()
    counts = np.zeros(256, np.int64)
    for t in texts:
        counts += np.bincount(fold[np.frombuffer(t[:WINDOW], np.uint8)], minlength=256)
    common = [b for b in np.argsort(-counts, kind="stable")[: CLASSES - 2] if counts[b]]
    by_byte = np.ones(256, np.uint8)
    by_byte[common] = np.arange(2, 2 + len(common))
    classes = by_byte[fold]
    x = np.zeros((len(texts), WINDOW + 4), np.intp)
    for row, t in zip(x, texts):
        part = np.frombuffer(t[:WINDOW], np.uint8)
        row[: len(part)] = classes[part]
    y = np.searchsorted(languages, labels)

    weights = [rng.normal(0, 0.1, (w, CLASSES, FILTERS)) for w in WIDTHS]
    weights += [np.zeros(FILTERS * len(WIDTHS)), rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(languages))), np.zeros(len(languages))]
    first, second, steps = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            xb, yb, steps = x[rows], y[rows], steps + 1
            peaks, pooled = [], []
            for w, table in zip(WIDTHS, weights):
                response = sum(table[k][xb[:, k : k + WINDOW]] for k in range(w))
                peak = response.argmax(axis=1)
                peaks.append(peak)
                pooled.append(np.take_along_axis(response, peak[:, None], axis=1)[:, 0])
            raw = np.concatenate(pooled, axis=1) + weights[-3]
            hidden = np.maximum(raw, 0)
            slope = softmax(hidden @ weights[-2] + weights[-1])
            slope[np.arange(len(yb)), yb] -= 1
            slope /= len(yb)
            back = (slope @ weights[-2].T) * (raw > 0)
            slopes = []
            for i, w in enumerate(WIDTHS):
                g, part = np.zeros_like(weights[i]), back[:, i * FILTERS : (i + 1) * FILTERS]
                filters = np.broadcast_to(np.arange(FILTERS), part.shape)
                for k in range(w):
                    np.add.at(g[k], (np.take_along_axis(xb, peaks[i] + k, axis=1), filters), part)
                slopes.append(g)
            slopes += [back.sum(axis=0), hidden.T @ slope, slope.sum(axis=0)]
            for w, g, m, v in zip(weights, slopes, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
    small = [w.astype(np.float32) for w in weights]
    return ByteCnn(languages, classes, dict(zip(WIDTHS, small)), *small[-3:])


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def pretender(text: str, kind: int, rng: np.random.Generator) -> str:
    """A text in the shape of ``text`` that is of none of its languages: a letter cipher (kind
    0, 1), random letters (2) or letters of another script (3)."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    if kind == 3:
        first, size = OTHER_SCRIPTS[int(rng.integers(len(OTHER_SCRIPTS)))]
        return "".join(chr(first + int(rng.integers(size))) if c.isalpha() else c for c in text)
    if kind == 2:
        return "".join(letters[int(rng.integers(26))] if c.isalpha() else c for c in text)
    key = dict(zip(letters, rng.permutation(list(letters)).tolist()))
    marked = {c: letters[int(rng.integers(26))] for c in set(text.lower()) if c.isalpha() and c not in key}
    return "".join((key | marked).get(c, c) for c in text.lower())


def train_with_other(texts: list[str], labels: list[str], seed: int = 11) -> ByteCnn:
    """A network with one more class, ``und``, learned from pretenders.

    Windows and their first whole words are learned alike, so short texts are calibrated too. Every
    fifth labelled text is held out: the offset of ``und`` is then lowered until no more than
    ``HELD_OUT_REJECTED`` of their windows would be rejected.
    """
    rng = np.random.default_rng(seed)
    held = np.arange(len(texts)) % 5 == 4

    def start(t: str) -> str:
        words = t.split()
        # A window may begin inside a word.
        return " ".join((words[1:] or words)[: int(rng.integers(1, 7))])

    given, names, kept = [], [], []
    for i, (t, label) in enumerate(zip(texts, labels)):
        both = [t, start(t)]
        if held[i]:
            kept += both
            continue
        given += both + [pretender(x, (i + k) % 4, rng) for k, x in enumerate(both)]
        names += [label, label, UNKNOWN, UNKNOWN]
    model = train([t.encode()[:WINDOW] for t in given], names)
    kept = [t.encode()[:WINDOW] for t in kept if any(c.isalpha() for c in t)]
    if kept:
        stream = np.zeros((len(kept), WINDOW), np.uint8)
        for row, t in zip(stream, kept):
            row[: len(t)] = model.classes[np.frombuffer(t, np.uint8)]
        chance = np.log(np.maximum(model.windows(stream.reshape(-1)), 1e-30))
        at = model.languages.index(UNKNOWN)
        margin = chance[:, at] - np.delete(chance, at, axis=1).max(axis=1)
        model.offset[at] -= max(0.0, float(np.quantile(margin, 1 - HELD_OUT_REJECTED)))
    return model


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", held_out_fold: int = 2, per_language: int = SAMPLE_PER_LANGUAGE, other: bool = False) -> ByteCnn | None:
    """Train on a sample bounded by ``per_language`` expected documents of each language.

    One window a sampled document, at an offset that its id decides, reaches the driver.
    ``other`` adds a class for texts in none of the languages.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (fold_of(F.col(doc_id)) != held_out_fold))
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not counts:
        return None
    shares = F.broadcast(spark.createDataFrame([(k, min(1.0, per_language / n)) for k, n in counts.items()], "__lang string, __share double"))
    place = F.floor(unit_hash(2, F.col("id")) * F.greatest(F.length(text) - WINDOW, F.lit(0))).cast("int") + 1
    taken = (
        rows.select(F.col(doc_id).alias("id"), F.col(lang).alias("__lang"), text)
        .join(shares, "__lang")
        .where(unit_hash(1, F.col("id")) < F.col("__share"))
        .select("id", "__lang", F.substring(F.col(text), place, F.lit(WINDOW)).alias("window"))
    )
    sample = sorted((r["id"], r["__lang"], r["window"]) for r in taken.collect())
    sample = [s for s in sample if s[2].strip()]
    if not sample:
        return None
    windows, names = [s[2] for s in sample], [s[1] for s in sample]
    model = train_with_other(windows, names) if other else train([w.encode() for w in windows], names)
    # The driver goes on for long; what training took should not stay with it.
    give_back()
    return model


def predict(df: DataFrame, model: ByteCnn | None, text: str = "text", keep: list[str] | None = None, lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the predicted language of the whole text and its score; ``keep`` names the other columns."""
    names = [n for n in (keep or df.columns) if n not in (lang_pred, score)]
    kept = [df.schema[n] for n in names]
    plain = [F.col(f"`{n}`") for n in names]
    if model is None:
        return df.select(*plain, F.lit(UNKNOWN).alias(lang_pred), F.lit(0.0).alias(score))
    schema = T.StructType([*kept, T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())])
    given, letter = free_names(df, 2, lang_pred, score)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_in_slices(batch, batch.num_columns - 2, most_bytes=2 << 20, most_rows=4096):
                texts = [t.encode() if t else b"" for t in part.column(given).to_pylist()]
                found, scores = model.predict(texts)
                letters = part.column(letter).to_pylist()
                arrays = [part.column(i) for i in range(len(names))]
                arrays.append(pa.array([f if ok else UNKNOWN for f, ok in zip(found, letters)], pa.string()))
                arrays.append(pa.array([float(s) if ok else 0.0 for s, ok in zip(scores, letters)], pa.float64()))
                yield pa.RecordBatch.from_arrays(arrays, [*names, lang_pred, score])

    content = F.col(f"`{text}`")
    rows = small_batches(df).select(*plain, content.alias(given), F.coalesce(content.rlike(r"\p{L}"), F.lit(False)).alias(letter))
    return rows.mapInArrow(frugal(work), schema)


def op8_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs)
    out = predict(docs, model, keep=["doc_id"])
    return out.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
