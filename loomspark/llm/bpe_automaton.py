"""BPE encoding and decoding with a deterministic tokenization automaton.

The merges are compiled, in priority order, into a deterministic automaton whose arcs are
labelled with tokens (merge-gadget construction; Berglund, Martens and van der Merwe,
"Constructing a BPE tokenization DFA", 2024). The automaton accepts exactly the token
sequences that byte-pair encoding produces. At the start one state loops on every base
symbol. The gadget for the merge ``a b -> c``

1. copies the state that the ``a`` arcs reach, without its ``b`` arc, and redirects every
   ``a`` arc to the copy (``a`` is never again followed by ``b``);
2. adds a ``c`` arc beside every ``a`` arc, to the state that the ``b`` arcs reached before.

All arcs with one label reach one state, so a state is named by that label, and a copy only
differs from its original by one missing arc. Hence a state is stored as a chain of
snapshots: ``c`` starts as the state of ``b`` as it was at the rank of the merge. The compiled
automaton is a few numpy tables, a handful of megabytes that the driver builds once and
broadcasts: ``removed`` ((state, label) -> rank), ``older`` (state -> older state, rank),
``left`` (label -> label in front, rank), and a trie of the labels' bytes.

Every prefix of a pre-split word has exactly one accepted path, so each position of a word
holds one state. All distinct words of a slice of rows go through the tables together: the
arcs that leave each position are read from the trie, then positions are settled from the
first byte on, each by the one arc whose source state has it. Nothing is kept from one slice
to the next. Decoding emits the labels of the arcs.

A tokenizer file is taken as it is: the texts of the splitting rule that is built in below are
split column by column, other rules and unusual characters by the library's own normalizer
and pre-tokenizer, and other decoders by the library's. What the automaton can't express
(dropout, unknown tokens, prefixes, vocabularies not of bytes) is an error.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from loomspark.llm.common import default_tokenizer_path, frugal, small_batches

ODD = np.uint64(0x9E3779B97F4A7C15)
START, NOWHERE = -1, -2
NEVER = np.iinfo(np.int32).max
#: Bytes of words that go through the tables together, and length from which a word goes alone.
CHUNK, LONG = 1 << 17, 512
#: Places for transitions that were asked for (8 bytes each).
TRANSITION_BITS = 19
#: First byte of a piece that stands for an added token (no UTF-8 text has it).
ADDED = b"\xff"


def byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols, spare = [""] * 256, 256
    for byte in range(256):
        if byte in plain:
            symbols[byte] = chr(byte)
        else:
            symbols[byte] = chr(spare)
            spare += 1
    return symbols


#: From a text of byte symbols to the text whose Latin-1 form has these bytes.
SYMBOL_BYTES = {ord(symbol): byte for byte, symbol in enumerate(byte_symbols())}


class Slots:
    """An open-addressing table from whole numbers to whole numbers, read by columns."""

    def __init__(self, entries: dict[int, int]):
        bits = max(4, (4 * len(entries)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        keys, values = np.fromiter(entries.keys(), np.int64, len(entries)), np.fromiter(entries.values(), np.int32, len(entries))
        place = self._home(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[place] == -1)
            free = free[np.unique(place[free], return_index=True)[1]]
            self.keys[place[free]], self.values[place[free]] = keys[free], values[free]
            waits = np.ones(len(keys), bool)
            waits[free] = False
            keys, values, place = keys[waits], values[waits], (place[waits] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * ODD) >> self.shift).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 for none."""
        place = self._home(keys)
        held = self.keys.take(place)
        out = self.values.take(place)
        open_ = np.flatnonzero(held != keys)
        out[open_] = -1
        open_ = open_[held[open_] != -1]
        while len(open_):
            place[open_] = (place[open_] + 1) & self.mask
            held = self.keys[place[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[place[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        return out


class TokenAutomaton:
    """The automaton over ``vocab`` (label -> id), compiled from ``merges`` in rank order."""

    def __init__(self, vocab: dict[str, int], merges: list, word_end: str = "</w>"):
        size = 1 + max(vocab.values(), default=0)
        self.labels = [""] * size
        for label, i in vocab.items():
            self.labels[i] = label
        removed: dict[int, int] = {}
        older: dict[int, tuple[int, int]] = {}
        left: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            front, back, whole = vocab[a], vocab[b], vocab[a + b]
            # Without a ``b`` arc behind ``a``, earlier merges never leave the two side by side.
            if self._derive_arc(front, back, removed, older, left):
                older[whole], left[whole] = (back, rank), (front, rank)
                removed[(front << 20) | back] = rank
        self.removed = Slots(removed)
        self.older, self.older_rank = self._column(older, size)
        self.left, self.left_rank = self._column(left, size)
        edges: dict[int, int] = {}
        inner, final, self.longest = [-1], [-1], 1
        for label, i in vocab.items():
            ends = bool(word_end) and label.endswith(word_end) and label != word_end
            symbols = label[: len(label) - len(word_end)] if ends else label
            if i not in left and len(symbols) > 1:
                continue
            node = 0
            for symbol in symbols:
                node = edges.setdefault(node << 8 | SYMBOL_BYTES[ord(symbol)], len(inner))
                if node == len(inner):
                    inner.append(-1)
                    final.append(-1)
            self.longest = max(self.longest, len(symbols))
            # Without a mark of the word's end, labels are the same inside and at the end.
            if ends or not word_end:
                final[node] = i
            if not ends:
                inner[node] = i
        self.edges, self.inner, self.final = Slots(edges), np.array(inner, np.int32), np.array(final, np.int32)
        self.transitions = np.full(1 << TRANSITION_BITS, -1, np.int64)

    @staticmethod
    def _column(entries: dict[int, tuple[int, int]], size: int) -> tuple[np.ndarray, np.ndarray]:
        other, rank = np.full(size, -1, np.int32), np.full(size, NEVER, np.int32)
        for label, pair in entries.items():
            other[label], rank[label] = pair
        return other, rank

    @staticmethod
    def _derive_arc(state: int, label: int, removed: dict, older: dict, left: dict) -> bool:
        """An arc is missing if it was removed before the labels built on it were added."""
        seen = NEVER
        while True:
            part, added = label, NEVER
            while True:
                rank = removed.get((state << 20) | part, NEVER)
                if rank < seen and rank <= added and rank != NEVER:
                    return False
                if part not in left:
                    break
                part, added = left[part]
            if state not in older:
                return True
            state, until = older[state]
            seen = min(seen, until)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "transitions"}

    def __setstate__(self, kept: dict) -> None:
        self.__dict__.update(kept)
        self.transitions = np.full(1 << TRANSITION_BITS, -1, np.int64)

    def has_arcs(self, state: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Whether each state has an arc with the label beside it in the finished automaton.

        ``transitions`` holds what was asked before, at a place that the pair decides.
        """
        out = state != NOWHERE
        at = np.flatnonzero(state >= 0)
        key = (state[at].astype(np.int64) << 20) | label[at]
        place = ((key.view(np.uint64) * ODD) >> np.uint64(64 - TRANSITION_BITS)).view(np.int64)
        held = self.transitions.take(place)
        out[at] = held & 1
        new = np.flatnonzero((held >> 1) != key)
        if len(new):
            found = self._derive_arcs(key[new])
            out[at[new]] = found
            self.transitions[place[new]] = (key[new] << 1) | found
        return out

    def _derive_arcs(self, key: np.ndarray) -> np.ndarray:
        out, at = np.ones(len(key), bool), np.arange(len(key))
        state, label = key >> 20, key & ((1 << 20) - 1)
        part, seen = label, np.full(len(at), NEVER, np.int32)
        added = seen
        while len(at):
            rank = self.removed.get((state << 20) | part)
            gone = (rank >= 0) & (rank < seen) & (rank <= added)
            out[at[gone]] = False
            front = self.left[part]
            deeper = front >= 0
            before = np.where(deeper, state, self.older[state])
            go = np.flatnonzero(~gone & (before >= 0))
            deeper = deeper[go]
            seen = np.where(deeper, seen[go], np.minimum(seen[go], self.older_rank[state[go]]))
            added = np.where(deeper, self.left_rank[part[go]], NEVER)
            at, label, state = at[go], label[go], before[go]
            part = np.where(deeper, front[go], label)
        return out

    def arcs(self, symbols: np.ndarray, end: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, label) of all labels that match from the positions ``at`` on."""
        node, length = np.zeros(len(at), np.int64), 0
        found = []
        while len(at):
            node = self.edges.get(node << 8 | symbols[at + length])
            length += 1
            known = node >= 0
            at, node = at[known], node[known].astype(np.int64)
            last = at + length == end[at]
            label = np.where(last, self.final[node], self.inner[node])
            met = label >= 0
            found.append((at[met], np.full(int(met.sum()), length), label[met]))
            at, node = at[~last], node[~last]
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([none, *c]).astype(np.int64) for c in zip(*found)) if found else (none, none, none)

    def run_words(self, symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Labels of the accepting paths of several words, and where each word's labels begin."""
        sizes = np.diff(offsets)
        begin, end = np.repeat(offsets[:-1], sizes), np.repeat(offsets[1:], sizes)
        start, length, label = self.arcs(symbols, end, np.arange(len(symbols)))
        step = (start + length - begin[start]).astype(np.uint16)
        order = np.argsort(step, kind="stable")
        start, length, label, first = start[order], length[order], label[order], (start == begin[start])[order]
        # The state behind each byte, the size of the label that ends there, labels up to there.
        state = np.full(len(symbols), NOWHERE, np.int32)
        size, count = np.zeros(len(symbols), np.int32), np.zeros(len(symbols), np.int32)
        groups = np.cumsum(np.bincount(step)) if len(step) else np.zeros(1, np.int64)
        for a, b in zip(groups[:-1].tolist(), groups[1:].tolist()):
            source = start[a:b] - 1
            there = np.flatnonzero(self.has_arcs(np.where(first[a:b], START, state[source]), label[a:b]))
            last = start[a:b][there] + length[a:b][there] - 1
            state[last], size[last] = label[a:b][there], length[a:b][there]
            count[last] = np.where(first[a:b][there], 0, count[source[there]]) + 1
        filled = np.flatnonzero(sizes)
        at, low = offsets[1:][filled] - 1, offsets[:-1][filled]
        many = np.zeros(len(sizes), np.int64)
        many[filled] = count[at]
        bounds = np.concatenate([[0], np.cumsum(many)])
        out, base = np.zeros(bounds[-1], np.uint32), bounds[filled] - 1
        while len(at):
            out[base + count[at]] = state[at]
            at = at - size[at]
            go = at >= low
            at, low, base = at[go], low[go], base[go]
        return out, bounds

    def run_long(self, symbols: np.ndarray) -> np.ndarray:
        """The path of one long word: which pairs of neighbouring labels may follow each other is
        read for all positions of a chunk at once, then one pass picks the path."""
        n = len(symbols)
        end = np.full(n, n)
        chosen = [NOWHERE] * (n + 1)
        chosen[0] = START
        length_of = {}
        for low in range(0, n, CHUNK // 8):
            high = min(n, low + CHUNK // 8)
            start, length, label = self.arcs(symbols, end, np.arange(max(0, low - self.longest), high))
            order = np.argsort(start + length, kind="stable")
            ends, before = (start + length)[order], label[order]
            mine = np.flatnonzero(start >= low)
            mine = mine[np.argsort(start[mine], kind="stable")]
            start, length, label = start[mine], length[mine], label[mine]
            length_of.update(zip(label.tolist(), length.tolist()))
            for i in np.flatnonzero(start == 0).tolist():
                chosen[int(length[i])] = int(label[i]) if chosen[int(length[i])] == NOWHERE else chosen[int(length[i])]
            lo, hi = np.searchsorted(ends, start, "left"), np.searchsorted(ends, start, "right")
            pairs = hi - lo
            b = np.repeat(np.arange(len(start)), pairs)
            a = np.arange(len(b)) + np.repeat(lo - np.cumsum(pairs) + pairs, pairs)
            good = np.flatnonzero(self.has_arcs(before[a], label[b]))
            b = b[good]
            for s, source, to, target in zip(start[b].tolist(), before[a[good]].tolist(), (start + length)[b].tolist(), label[b].tolist()):
                if chosen[s] == source:
                    chosen[to] = target
        path, at = [], n
        while at:
            path.append(chosen[at])
            at -= length_of[chosen[at]]
        return np.array(path[::-1], np.uint32)

    def run_column(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same as ``run_words`` for a binary column of any number and length of words."""
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = words.buffers()[2]
        symbols = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        sizes, parts, many = np.diff(offsets), [], []
        at = 0
        while at < len(words):
            if sizes[at] >= LONG:
                parts.append(self.run_long(symbols[offsets[at] : offsets[at + 1]]))
                many.append([len(parts[-1])])
                at += 1
                continue
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
            long = np.flatnonzero(sizes[at:to] >= LONG)
            to = at + int(long[0]) if len(long) else to
            ids, bounds = self.run_words(symbols[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            parts.append(ids)
            many.append(np.diff(bounds))
            at = to
        counts = np.concatenate(many) if many else np.zeros(0, np.int64)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

    def run(self, symbols: str) -> list[int]:
        """The labels of the one accepting path over a word's byte symbols."""
        return self.run_column(pa.array([symbols.translate(SYMBOL_BYTES).encode("latin-1")], pa.binary()))[0].tolist()


#: Code points whose split, case and normal form need no Unicode tables: below U+0250,
#: without the number-like and case-changing exceptions, and common punctuation.
_UNUSUAL = re.compile("[^\t-\r -\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ‐-‧€]")
#: The splitting rule of the vocabulary, restricted to those code points, and the
#: parts of a tokenizer file that ask for it.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
BUILT_IN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Without apostrophes a run of marks or a digit is one piece whatever surrounds it.
_APART = r"([^\s\x0b\p{L}\p{N}]+|\p{N})"


class WordBpe:
    """Encodes whole texts: added tokens, normalization, splitting, then the automaton.

    Ids are packed as little-endian unsigned 32-bit integers.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, word_end = model["vocab"], model.get("end_of_word_suffix") or ""
        refused = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type", "BPE") != "BPE" or refused:
            raise ValueError(f"The automaton takes no model of this kind: {refused or model['type']}.")
        if any(symbol + end not in vocab for symbol in byte_symbols() for end in {"", word_end}):
            raise ValueError("The vocabulary lacks byte symbols.")
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in spec["added_tokens"]):
            raise ValueError("Added tokens that depend on what surrounds them are not supported.")
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_pattern = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.automaton = TokenAutomaton(vocab, merges, word_end)
        labels = self.automaton.labels + [""] * (1 + max([*vocab.values(), *self.added.values()]) - len(self.automaton.labels))
        for label, i in self.added.items():
            labels[i] = label
        self.arc_labels = pa.array(labels, pa.string())
        self.automaton.labels = []
        self.built_in = all(spec[k] == v for k, v in BUILT_IN.items())
        # The library without its vocabulary: normal forms, splitting and decoders only.
        small = {**{k: spec.get(k) for k in ("version", "normalizer", "pre_tokenizer", "decoder")}, "truncation": None, "padding": None, "added_tokens": [], "post_processor": None, "model": {"type": "BPE", "vocab": {}, "merges": []}}
        self.parts_spec, self.plain_decoder = json.dumps(small), spec.get("decoder") is None
        self._parts = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_parts": None}

    @property
    def parts(self):
        if self._parts is None:
            from tokenizers import Tokenizer

            self._parts = Tokenizer.from_str(self.parts_spec)
        return self._parts

    def _split(self, text: str) -> list[bytes]:
        """The pieces of a text without added tokens."""
        if self.built_in and not _UNUSUAL.search(text):
            return [w.encode() for w in _SPLIT.findall(text.lower())]
        normalizer, splitter = self.parts.normalizer, self.parts.pre_tokenizer
        normal = normalizer.normalize_str(text) if normalizer else text
        if splitter is None:
            return [normal.translate(SYMBOL_BYTES).encode("latin-1")] if normal else []
        return [piece.translate(SYMBOL_BYTES).encode("latin-1") for piece, _ in splitter.pre_tokenize_str(normal)]

    def pieces(self, text: str | None) -> list[bytes]:
        """The pieces of a text; an added token is ``ADDED`` and its id."""
        if not text:
            return []
        if self.added_pattern is None:
            return self._split(text)
        out, at = [], 0
        for match in self.added_pattern.finditer(text):
            out += self._split(text[at : match.start()])
            out.append(ADDED + self.added[match[0]].to_bytes(4, "little"))
            at = match.end()
        return out + self._split(text[at:])

    def encode(self, text: str | None) -> bytes:
        return self.encode_column(pa.array([text], pa.string()))[0]

    def encode_flat(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column one behind the other, and each text's first place.

        Ordinary texts are split together; each distinct piece goes through the automaton once.
        """
        column = column.cast(pa.string())
        texts = column.to_pylist()
        plain = np.array([self.built_in and bool(t) and "<|" not in t and "'" not in t and not _UNUSUAL.search(t) for t in texts], bool)
        runs = pc.utf8_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(column.filter(pa.array(plain))), _APART, r" \1 "))
        others = [self.pieces(t) for t, p in zip(texts, plain) if not p]
        together = [runs.flatten().cast(pa.binary()), pa.array([x for pieces in others for x in pieces], pa.binary())]
        coded = pa.concat_arrays(together).dictionary_encode()
        ids, bounds = self._encode_distinct(coded.dictionary)
        counts = np.zeros(len(texts), np.int64)
        counts[plain] = np.diff(runs.offsets.to_numpy())
        counts[~plain] = [len(pieces) for pieces in others]
        number = coded.indices.to_numpy()
        if len(others) and plain.any():
            first = np.zeros(len(texts), np.int64)
            first[plain] = np.cumsum(counts[plain]) - counts[plain]
            first[~plain] = counts[plain].sum() + np.cumsum(counts[~plain]) - counts[~plain]
            number = number[np.arange(counts.sum()) + np.repeat(first - np.cumsum(counts) + counts, counts)]
        sizes = np.diff(bounds)[number]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        out = ids[np.arange(ends[-1]) + np.repeat(bounds[:-1][number] - ends[:-1], sizes)]
        return out, ends[np.concatenate([[0], np.cumsum(counts)])]

    def _encode_distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        marks = pc.starts_with(pieces, pattern=ADDED).to_numpy(zero_copy_only=False).astype(bool)
        if not marks.any():
            return self.automaton.run_column(pieces)
        ids, bounds = self.automaton.run_column(pieces.filter(pa.array(~marks)))
        sizes = np.ones(len(pieces), np.int64)
        sizes[~marks] = np.diff(bounds)
        out, marked = np.zeros(sizes.sum(), np.uint32), np.repeat(marks, sizes)
        out[~marked] = ids
        out[marked] = [int.from_bytes(p[1:], "little") for p in pieces.filter(pa.array(marks)).to_pylist()]
        return out, np.concatenate([[0], np.cumsum(sizes)])

    def encode_column(self, column: pa.Array) -> list[bytes]:
        """Packed ids of every text of a column."""
        ids, bounds = self.encode_flat(column)
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def decode_flat(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The text of each stretch of ids: labels joined by a space where the file has no decoder."""
        labels = self.arc_labels.take(pa.array(ids))
        if self.plain_decoder:
            return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), labels), " ")
        names = labels.to_pylist()
        return pa.array([self.parts.decoder.decode(names[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.string())

    def decode(self, ids: bytes) -> str:
        found = np.frombuffer(ids, np.uint32)
        return self.decode_flat(found, np.array([0, len(found)]))[0].as_py()


_OPEN: dict[str, WordBpe] = {}


def open_bpe(path: str) -> WordBpe:
    """The compiled automaton of a vocabulary file, once a process."""
    if path not in _OPEN:
        _OPEN[path] = WordBpe(path)
    return _OPEN[path]


def published(spark: SparkSession, path: str) -> Broadcast:
    """The compiled automaton for all tasks: a few megabytes, whatever the data; executors need
    no vocabulary file."""
    return spark.sparkContext.broadcast(open_bpe(path))


def rows_in_slices(batch: pa.RecordBatch, text_at: int, most_bytes: int = 4 << 20, most_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most_bytes`` of text each, so that outputs stay small."""
    column = batch.column(text_at)
    per_row = max(1, column.nbytes // max(1, len(column)))
    step = max(1, min(most_rows, most_bytes // per_row))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def encode(df: DataFrame, text: str = "text", tokenizer: str | None = None, ids: str = "ids", decoded: str | None = "decoded") -> DataFrame:
    """Add to every row the token ids of its whole text and, if asked, their decoded text.

    ``ids`` is binary: little-endian unsigned 32-bit integers. A null text counts as empty:
    no ids, empty decoded text. Texts of any length are encoded whole; a clashing column of
    the same name is replaced. Row order and repeated rows stay.
    """
    shared = published(df.sparkSession, tokenizer or default_tokenizer_path())
    kept = [f for f in df.schema.fields if f.name not in (ids, decoded)]
    schema = T.StructType([*kept, T.StructField(ids, T.BinaryType()), *([T.StructField(decoded, T.StringType())] if decoded else [])])
    names = [f.name for f in kept]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value
        for batch in batches:
            for part in rows_in_slices(batch, batch.schema.get_field_index(text)):
                found, bounds = bpe.encode_flat(part.column(text))
                packed = [found[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                arrays = [part.column(n) for n in names] + [pa.array(packed, pa.binary())]
                if decoded:
                    arrays.append(bpe.decode_flat(found, bounds))
                yield pa.RecordBatch.from_arrays(arrays, [*names, ids, *([decoded] if decoded else [])])

    return small_batches(df).mapInArrow(frugal(work), schema)


def decode(df: DataFrame, ids: str = "ids", tokenizer: str | None = None, decoded: str = "decoded") -> DataFrame:
    """Add the text of packed ids; null ids give an empty text."""
    shared = published(df.sparkSession, tokenizer or default_tokenizer_path())
    kept = [f for f in df.schema.fields if f.name != decoded]
    schema = T.StructType([*kept, T.StructField(decoded, T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value
        for batch in batches:
            texts = [bpe.decode(p or b"") for p in batch.column(ids).to_pylist()]
            arrays = [batch.column(f.name) for f in kept] + [pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [*(f.name for f in kept), decoded])

    return small_batches(df).mapInArrow(frugal(work), schema)
