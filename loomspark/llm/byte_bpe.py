"""Byte-level BPE by a global shuffle of distinct words.

1. Texts are split into words (pre-tokens) in slices of some megabytes. Each distinct word of a
   slice has a number there; a text becomes the numbers of its words, in the order of their
   positions. The words of a slice, with their numbers, are dealt into buckets by their hash.
2. The rows of a bucket, one a slice, are brought together. Each distinct word of the bucket, and
   so of the whole table, is encoded once, and its ids are joined to every slice that has it.
3. Slices are put together again: the ids of a slice's words are laid out at the positions that
   hold their numbers. Texts are written bucketed by slice, so only the words' ids move to them.

A word is named once a slice however often it occurs there, and a bucket has one row a slice, so
no word makes a task larger than others. Frequent words of a slice have small numbers, so a
position takes about two bytes. What the slices give is written to the shared folder first, so
that words and texts have the same numbers even if executors are lost. A task holds the distinct
words of one bucket (``BUCKETS`` is a parameter) and one slice at a time.

Decoding joins the token-byte table: its size is that of the vocabulary, so it is broadcast and
each id takes its bytes from it by its place.

Defined cases: a null text counts as empty: no ids, no bytes. Texts and words of any length are
encoded whole; the time for a word grows with n log n. Repeated rows stay, as often as they
occur. An empty table gives no rows. Only the columns named by ``keep`` are carried along, under
their own names, whatever they are; the new column replaces one of its name.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.llm.bpe_automaton import rows_in_slices
from loomspark.llm.common import bucketed, frugal, read_table, small_batches

#: Characters and texts after which a slice ends; it holds at most one text more.
SLICE_BYTES, SLICE_ROWS = 24 << 20, 16384
#: Bytes of codes that are laid out together.
CODES_AT_ONCE = 1 << 19
#: Buckets that words are dealt into.
BUCKETS = 1 << 12
#: The splitting rule for texts of ASCII alone; others go through the vocabulary's own pattern.
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)


def default_ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks (also their ids), from a file of base64 and rank a line."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"The vocabulary lacks single bytes: {missing[:5]}.")
    return ranks


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: the neighbours of lowest joint rank are merged, the first of equals."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    # A part starts at ``i`` and ends where the next one starts; a merged one has end 0.
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    waiting = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(waiting)
    while waiting:
        _, i, stop = heapq.heappop(waiting)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (rank := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(waiting, (rank, i, end[stop]))
        if before[i] >= 0 and (rank := ranks.get(word[before[i] : stop])) is not None:
            heapq.heappush(waiting, (rank, before[i], stop))
    out, at = [], 0
    while at < n:
        out.append(ranks[word[at : end[at]]])
        at = end[at]
    return out


class Splitter:
    """Cuts a text into the pattern's matches."""

    def __init__(self, pattern: str | None = None):
        import public_tokenizers
        import regex

        # The quick rule is that of the pattern that the vocabulary came with.
        self.plain = PLAIN.findall if pattern in (None, public_tokenizers.PATTERN) else None
        self.every = regex.compile(pattern or public_tokenizers.PATTERN)

    def words(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.plain and text.isascii():
            return self.plain(text)
        # Not findall: a caller's pattern may have groups.
        return [m[0] for m in self.every.finditer(text)]


def pack_many(numbers: np.ndarray, ends: list[int]) -> list[bytes]:
    """Stretches of whole numbers below 2^28, each number as one to four bytes, seven bits a byte,
    lowest first; ``ends`` are the stretches' ends."""
    numbers = numbers.astype(np.uint32)
    sizes = 1 + (numbers >= 1 << 7) + (numbers >= 1 << 14) + (numbers >= 1 << 21)
    after = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(int(after[-1]), np.uint8)
    for i in range(4):
        at = np.flatnonzero(sizes > i)
        out[after[at] + i] = ((numbers[at] >> 7 * i) & 127) | np.where(sizes[at] > i + 1, 128, 0)
    data, cuts = out.tobytes(), after[[0, *ends]].tolist()
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def pack(numbers: np.ndarray) -> bytes:
    return pack_many(numbers, [len(numbers)])[0]


def unpack(data: bytes) -> np.ndarray:
    parts = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(parts < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    out = (parts[first] & 127).astype(np.int64)
    for i in range(1, 4):
        at = np.flatnonzero(last - first >= i)
        out[at] |= (parts[first[at] + i] & 127).astype(np.int64) << 7 * i
    return out


def slices_of(df: DataFrame, text: str, keep: list[str], pattern: str | None) -> DataFrame:
    """One row a bucket of a slice's words (their numbers as packed differences, their packed
    lengths, and the words one behind the other) and one a text (kept, codes)."""
    kept = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType(
        [
            T.StructField("slice", T.LongType()),
            T.StructField("kept", kept.schema["kept"].dataType),
            T.StructField("codes", T.BinaryType()),
            T.StructField("bucket", T.IntegerType()),
            T.StructField("numbers", T.BinaryType()),
            T.StructField("lengths", T.BinaryType()),
            T.StructField("words", T.BinaryType()),
        ]
    )

    def binary(values: Iterator[bytes]) -> pa.Array:
        return pa.array(values, pa.binary())

    def rows(made: int, kept: list[pa.Array], codes: array, ends: list[int], words: list[str]) -> Iterator[pa.RecordBatch]:
        """The rows of a slice, whose words are numbered anew by how often they occur."""
        code = np.frombuffer(codes, np.uint32)
        order = np.argsort(-np.bincount(code, minlength=len(words)), kind="stable")
        number = np.empty(len(order), np.uint32)
        number[order] = np.arange(len(order))
        done = start = 0
        for part in kept:
            n = len(part)
            stop = ends[done + n - 1] if n else start
            packed = binary(pack_many(number[code[start:stop]], [e - start for e in ends[done : done + n]]))
            done, start = done + n, stop
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, made)), part, packed, pa.nulls(n, pa.int32()), *[pa.nulls(n, pa.binary())] * 3], schema.names)
        data = [w.encode() for w in words]
        bucket = np.fromiter((zlib.crc32(w) % BUCKETS for w in data), np.int32, len(data))
        order = np.lexsort((number, bucket))
        starts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        n, mine = len(starts), np.split(order, starts[1:])[: len(starts)]
        # Numbers ascend in a bucket: of all but its first the difference to the one before is kept.
        steps = np.diff(number[order].astype(np.int64), prepend=0)
        steps[starts] = number[order[starts]]
        ends = [*starts[1:].tolist(), len(order)] if n else []
        numbers = binary(pack_many(steps, ends))
        lengths = binary(pack_many(np.fromiter(map(len, data), np.int64, len(data))[order], ends))
        joined = binary(b"".join([data[j] for j in i.tolist()]) for i in mine)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, made)), pa.nulls(n, kept[0].type), pa.nulls(n, pa.binary()), pa.array(bucket[order[starts]]), numbers, lengths, joined], schema.names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, made = Splitter(pattern), TaskContext.get().partitionId() << 33
        kept, codes, ends, numbers, size = [], array("I"), [], {}, 0
        for batch in batches:
            for part in rows_in_slices(batch, 1, SLICE_BYTES, SLICE_ROWS):
                kept.append(part.column(0))
                for text in part.column(1).to_pylist():
                    codes.extend([numbers.setdefault(w, len(numbers)) for w in splitter.words(text)])
                    ends.append(len(codes))
                    size += len(text or "")
                if size >= SLICE_BYTES or len(ends) >= SLICE_ROWS:
                    yield from rows(made, kept, codes, ends, list(numbers))
                    kept, codes, ends, numbers, size, made = [], array("I"), [], {}, 0, made + 1
        if kept:
            yield from rows(made, kept, codes, ends, list(numbers))

    return small_batches(kept).mapInArrow(frugal(work), schema)


def encode_words(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """From (bucket, slice, numbers, lengths, words) to (slice, numbers, packed sizes, ids of the words)."""
    shared = words.sparkSession.sparkContext.broadcast(ranks)
    together = words.repartition("bucket").sortWithinPartitions("bucket")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, at, known = shared.value, None, {}
        kind = id_kind(ranks)
        for batch in batches:
            sizes, ids = [], []
            for bucket, lengths, data in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if bucket != at:
                    at, known = bucket, {}
                ends = np.cumsum(unpack(lengths)).tolist()
                found = [data[a:b] for a, b in zip([0, *ends], ends)]
                for word in found:
                    if word not in known:
                        known[word] = np.array(encode_word(word, ranks), kind)
                mine = [known[w] for w in found]
                sizes.append(pack(np.array([len(x) for x in mine])))
                ids.append(np.concatenate(mine).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())], ["slice", "numbers", "sizes", "ids"])

    return together.mapInArrow(frugal(work), "slice long, numbers binary, sizes binary, ids binary")


def id_kind(ranks: dict[bytes, int]) -> str:
    return "<u2" if max(ranks.values()) < 1 << 16 else "<u4"


def reassembled(texts: DataFrame, words: DataFrame, kind: str) -> DataFrame:
    """Texts (home, kept, codes) with what ``encode_words`` gives for their slice: (kept, ids)."""
    schema = T.StructType([texts.schema["kept"], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def joined(codes: list[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Several texts' codes one behind the other, and how many each has."""
        start = size = 0
        for i, code in enumerate(codes):
            size += len(code)
            if size >= CODES_AT_ONCE or i + 1 == len(codes):
                some = codes[start : i + 1]
                yield b"".join(some), [int((np.frombuffer(c, np.uint8) < 128).sum()) for c in some]
                start, size = i + 1, 0

    def work(texts: pa.Table, words: pa.Table) -> pa.Table:
        numbers = [np.cumsum(unpack(x)) for x in words.column("numbers").to_pylist()]
        number = np.concatenate([np.zeros(0, np.int64), *numbers])
        size = np.concatenate([np.zeros(0, np.int64), *map(unpack, words.column("sizes").to_pylist())])
        flat = np.frombuffer(b"".join(words.column("ids").to_pylist()), kind).astype(np.int32)
        sizes, first = np.zeros_like(size), np.zeros_like(size)
        sizes[number], first[number] = size, np.cumsum(size) - size
        first, sizes = first.astype(np.int32), sizes.astype(np.int32)
        parts, bounds = [], [np.zeros(1, np.int64)]
        for data, counts in joined(texts.column("codes").to_pylist()):
            number = unpack(data)
            length = sizes[number]
            ends = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
            parts.append(flat[np.arange(ends[-1]) + np.repeat(first[number] - ends[:-1], length)])
            bounds.append(bounds[-1][-1] + ends[np.cumsum(counts)])
        ids = pa.ListArray.from_arrays(pa.array(np.concatenate(bounds), pa.int32()), pa.array(np.concatenate([flat[:0], *parts]), pa.int32()))
        return pa.table([texts.column("kept"), ids], ["kept", "ids"])

    return texts.groupBy("home").cogroup(words.groupBy("slice")).applyInArrow(work, schema)


def encode(df: DataFrame, keep: list[str], text: str = "text", ids: str = "ids", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The columns ``keep`` of every row, and ``ids``: the ids (array<int>) of its whole text."""
    keep = [c for c in keep if c != ids]
    ranks = read_ranks(ranks_path or default_ranks_path())
    slices = bucketed(slices_of(df, text, keep, pattern), "slice", "words")
    words = encode_words(slices.where("bucket is not null").select("bucket", "slice", "numbers", "lengths", "words"), ranks)
    out = reassembled(slices.where("codes is not null").select(F.col("slice").alias("home"), "kept", "codes"), words, id_kind(ranks))
    return out.select(*[F.col("kept").getField(c).alias(c) for c in keep], F.col("ids").alias(ids))


def decode(df: DataFrame, ids: str = "ids", decoded: str = "decoded", ranks_path: str | None = None) -> DataFrame:
    """Add the bytes of each row's ids (null ids: none), by the token-byte table.

    A null id inside the ids adds nothing; an id that the table lacks is an error.
    """
    ranks = read_ranks(ranks_path or default_ranks_path())
    table = [b""] * (1 + max(ranks.values()))
    known = np.zeros(len(table), bool)
    for token, i in ranks.items():
        table[i], known[i] = token, True
    shared = df.sparkSession.sparkContext.broadcast((table, known))
    kept = [f for f in df.schema.fields if f.name != decoded]
    schema = T.StructType([*kept, T.StructField(decoded, T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, known = pa.array(shared.value[0], pa.binary()), shared.value[1]
        for batch in batches:
            lists = batch.column(ids).fill_null([])
            places = lists.flatten()
            asked = places.drop_null().to_numpy()
            if len(asked) and not (asked.min() >= 0 and asked.max() < len(known) and known[asked].all()):
                raise ValueError("There are ids that the token-byte table lacks.")
            # What is taken stands in one buffer already: only each row's end is looked up in it.
            taken = tokens.take(places) if len(places) else tokens[:0]
            ends = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset :] if len(places) else np.zeros(1, np.int32)
            counts = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            bounds = ends[np.concatenate([[0], counts]).astype(np.int64)]
            text = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(bounds.astype(np.int32)), taken.buffers()[2] or pa.py_buffer(b"")])
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), text], schema.names)

    return small_batches(df).mapInArrow(frugal(work), schema)


def op12_distinct_word_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digests of every document's ids and of the bytes that they decode to."""
    out = decode(encode(read_table(spark, sf_dir, "documents"), ["doc_id"]))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
