"""Harmonic packing of documents into fixed-capacity token sequences.

A document's ids are cut into full sequences, then pieces of 1/2, 1/4, ... of the capacity
down to ``smallest`` tokens, and one tail. A piece of ``n`` tokens belongs to the
reciprocal class ``k = capacity // n``; every bin of class ``k`` holds exactly ``k`` pieces
(harmonic packing), so bins of the cut classes are exactly full and a tail bin leaves less
than one tail unused.

Each worker fills its own bins while it tokenizes and gives a bin's pieces out once it has all
of them, so nothing is shuffled, a worker holds no more than one open bin a class, and a lost
one is repeated by itself. At its end a worker puts its open bins (at most one a class, and the
number of classes is fixed by the capacity) together first-fit by decreasing size, and cuts
what is not full into lengths of powers of two, which need no padding. A sequence's number holds
that of its worker.

Defined cases: a null or empty text is a document of its end id alone; texts of any length
are cut whole; repeated rows are packed as often as they occur; an empty table gives no
rows. A null document id is kept, and ids of any type; other columns, whatever their names, play
no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.llm.bpe_automaton import published, rows_in_slices
from loomspark.llm.common import default_tokenizer_path, frugal, read_table, small_batches

CAPACITY = 2048
#: Shortest piece that a remainder is cut into; what is left is the tail.
SMALLEST = 64
END_ID = 1


def cut_lengths(n: int, capacity: int = CAPACITY, smallest: int = SMALLEST) -> list[int]:
    """Lengths of the pieces of ``n`` tokens, in the order of the text."""
    out = [capacity] * (n // capacity)
    rest, part = n % capacity, capacity // 2
    while part >= smallest and part:
        if rest >= part:
            out.append(part)
            rest -= part
        part //= 2
    return out + [rest] * (rest > 0)


@dataclass
class Piece:
    """A stretch of a document's ids, and where it is in its sequence."""

    doc_id: object
    start: int
    ids: bytes
    doc_tokens: int
    sequence_id: int = -1
    offset: int = -1

    def __len__(self) -> int:
        return len(self.ids) // 4

    def split(self, n: int) -> tuple[Piece, Piece]:
        """The first ``n`` ids and the rest."""
        return replace(self, ids=self.ids[: 4 * n]), replace(self, start=self.start + n, ids=self.ids[4 * n :])


class Bins:
    """The open bin of every class of one worker."""

    def __init__(self, worker: int, capacity: int):
        self.capacity, self.sequence = capacity, worker << 33
        self.open: dict[int, list[Piece]] = {}

    def finished(self, pieces: list[Piece]) -> list[Piece]:
        """The pieces as one sequence."""
        at = 0
        for piece in pieces:
            piece.sequence_id, piece.offset = self.sequence, at
            at += len(piece)
        self.sequence += 1
        return pieces

    def add(self, piece: Piece) -> list[Piece]:
        """The pieces of the bin that this one fills, or none yet."""
        group = self.capacity // len(piece)
        held = self.open.setdefault(group, [])
        held.append(piece)
        return self.finished(self.open.pop(group)) if len(held) == group else []

    def rest(self) -> list[Piece]:
        """The pieces of all open bins: bins go together first-fit by decreasing size, and a
        sequence that is not full is cut where the powers of two in its length end, none of which
        is padded."""
        sequences: list[list[Piece]] = []
        room: list[int] = []
        size = lambda pieces: sum(map(len, pieces))
        for _, pieces in sorted(self.open.items(), key=lambda x: (-size(x[1]), x[0])):
            at = next((i for i, free in enumerate(room) if free >= size(pieces)), len(room))
            if at == len(room):
                room.append(self.capacity)
                sequences.append([])
            room[at] -= size(pieces)
            sequences[at] += pieces
        self.open = {}
        out = []
        for pieces in sequences:
            left = size(pieces)
            while left:
                wanted = 1 << (left.bit_length() - 1)
                left, taken = left - wanted, []
                while wanted:
                    piece = pieces.pop(0)
                    if len(piece) > wanted:
                        piece, more = piece.split(wanted)
                        pieces.insert(0, more)
                    taken.append(piece)
                    wanted -= len(piece)
                out += self.finished(taken)
        return out


def pack_documents(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    smallest: int = SMALLEST,
    end_id: int = END_ID,
    payload: str = "ids",
) -> DataFrame:
    """Pieces with their ids, ``sequence_id`` and ``offset`` in it (see the module's notes).

    With ``payload`` "crc" the CRC-32 of a piece's ids is given in their place, taken from the
    finished pieces.
    """
    shared = published(df.sparkSession, tokenizer or default_tokenizer_path())
    rows = small_batches(df).select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType
    fields = [("doc_id", kind), ("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())]
    schema = T.StructType([T.StructField(*f) for f in fields])
    last = end_id.to_bytes(4, "little")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, bins = shared.value, Bins(TaskContext.get().partitionId(), capacity)
        types = [None, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

        def table(pieces: list[Piece]) -> pa.RecordBatch:
            columns = zip(*((p.doc_id, p.start, len(p), p.ids, p.doc_tokens, p.sequence_id, p.offset) for p in pieces))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], schema.names)

        for batch in batches:
            types[0] = batch.schema.field(0).type
            for part in rows_in_slices(batch, 1):
                done: list[Piece] = []
                for doc, packed in zip(part.column(0).to_pylist(), bpe.encode_column(part.column(1))):
                    ids, start = packed + last, 0
                    for n in cut_lengths(len(ids) // 4, capacity, smallest):
                        done += bins.add(Piece(doc, start, ids[4 * start : 4 * (start + n)], len(ids) // 4))
                        start += n
                if done:
                    yield table(done)
        if left := bins.rest():
            yield table(left)

    out = rows.mapInArrow(frugal(work), schema)
    return digests(out) if payload == "crc" else out


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in the place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def assemble_sequences(pieces: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """The packed sequences themselves: ids (binary), and lengths of their pieces for masks.

    Padded to ``capacity`` with ``pad_id`` unless the length is a power of two.
    """
    pad = pad_id.to_bytes(4, "little").hex()
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "length")))
    out = pieces.groupBy("sequence_id").agg(parts.alias("p"))
    n = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    joined = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), ""))
    power = (n.bitwiseAND(n - 1)) == 0
    padding = F.when(power, F.lit("")).otherwise(F.repeat(F.lit(pad), (F.lit(capacity) - n).cast("int")))
    return out.select("sequence_id", F.concat(joined, F.unhex(padding)).alias("ids"), F.transform("p", lambda x: x["length"]).alias("lengths"))


def op5_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document went, with the CRC-32 of its ids."""
    return digests(pack_documents(read_table(spark, sf_dir, "documents")))
