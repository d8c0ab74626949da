"""Words of texts that are written without spaces.

A dictionary with counts spans all ways to cut a text; the most probable one is found from the
end backwards, each place keeping the best word that begins there. Where that leaves a run of
single characters that the dictionary doesn't know as a word, the run is cut by a hidden Markov
model of the places in a word (begin, middle, end, alone), by the Viterbi algorithm. Both are
trained on a table of words: counting is Spark's, and the dictionary that tasks get is bounded
by a parameter.

Defined cases: null stays null, an empty text has no words; letters and digits of other scripts
are words as they stand, other marks are words of one character, and white space only parts
words; of equally probable cuts the one with the longer first word is taken; a model without
words takes every character for a word.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from loomspark.functions.lineage import cut_lineage

#: Scripts without spaces: Han, kana, Thai, Lao, Khmer, Myanmar.
UNSPACED = "฀-໿က-႟ក-៿々-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
PARTS = re.compile(f"([{UNSPACED}]+)|([^\\W{UNSPACED}]+)|(\\S)")
#: Most words of a dictionary that tasks get, longest word, and what stands for a count of none.
MOST_WORDS, LONGEST, NEVER = 500_000, 16, -1e9
STATES = "BMES"
#: Which place in a word may follow which.
FOLLOWS = {"B": "ES", "M": "BM", "E": "BM", "S": "ES"}


@dataclass
class Segmenter:
    words: dict[str, int]
    #: Logarithms: of starting with a state, of going from one to the next, of a state's characters.
    start: dict[str, float] = field(default_factory=dict)
    moves: dict[tuple[str, str], float] = field(default_factory=dict)
    shows: dict[str, dict[str, float]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.total = math.log(max(1, sum(self.words.values())))
        # Beginnings of words are in the trie too, as None, so that a walk knows when to end.
        self.chances: dict[str, float | None] = {w[:i]: None for w in self.words for i in range(1, len(w))}
        self.chances |= {w: math.log(n) - self.total if n else None for w, n in self.words.items()}

    def cuts(self, text: str) -> list[str]:
        """The most probable cut into dictionary words and single characters."""
        n, chances, alone = len(text), self.chances, -self.total
        ends, bests = list(range(1, n + 2)), [0.0] * (n + 1)
        for i in range(n - 1, -1, -1):
            known = chances.get(text[i], -math.inf)
            chance, end, j = (alone if known is None or known == -math.inf else known) + bests[i + 1], i + 1, i + 2
            while j <= n and (known := chances.get(text[i:j], -math.inf)) != -math.inf:
                if known is not None and (found := known + bests[j]) >= chance:
                    chance, end = found, j
                j += 1
            bests[i], ends[i] = chance, end
        out, at = [], 0
        while at < n:
            out.append(text[at : ends[at]])
            at = ends[at]
        return out

    def unknown(self, text: str) -> list[str]:
        """A run of unknown characters by the most probable places in words."""
        if len(text) == 1 or not self.shows:
            return list(text)
        show = lambda state, c: self.shows.get(state, {}).get(c, NEVER)
        chance = {s: self.start.get(s, NEVER) + show(s, text[0]) for s in STATES}
        paths = []
        for c in text[1:]:
            last, chance, path = chance, {}, {}
            for s in STATES:
                value, before = max((last[b] + self.moves.get((b, s), NEVER), b) for b in FOLLOWS[s])
                chance[s], path[s] = value + show(s, c), before
            paths.append(path)
        state = max("ES", key=lambda s: chance[s])
        states = [state]
        for path in reversed(paths):
            state = path[state]
            states.append(state)
        out, word = [], ""
        for c, s in zip(text, reversed(states)):
            word += c
            if s in "ES":
                out.append(word)
                word = ""
        return out + [word] * bool(word)

    def segment(self, text: str) -> list[str]:
        out: list[str] = []
        for found in PARTS.finditer(text):
            if not found[1]:
                out.append(found[0])
                continue
            run = ""
            for word in self.cuts(found[1]):
                if len(word) == 1 and word not in self.words:
                    run += word
                    continue
                out += self.unknown(run) if run else []
                run = ""
                out.append(word)
            out += self.unknown(run) if run else []
        return out


def train_segmenter(words: DataFrame, word: str = "word", n: str = "n", most_words: int = MOST_WORDS, longest: int = LONGEST) -> Segmenter:
    """A segmenter of counted words: the ``most_words`` most frequent ones (up to ``longest``
    characters; of equals the smaller) as its dictionary, all of them for the places in words."""
    # Written once: the texts behind the words are not counted again for each of the tables below.
    counted = cut_lineage(words.where(F.col(word).isNotNull() & (F.length(word) > 0) & (F.col(n) > 0)).groupBy(F.col(word).alias("w")).agg(F.sum(n).alias("n")))
    short = counted.where(F.length("w") <= longest)
    held = {r["w"]: r["n"] for r in short.orderBy(F.desc("n"), "w").limit(most_words).collect()}
    size = F.length("w")
    place = lambda i: F.when(size == 1, "S").when(i == 0, "B").when(i == size - 1, "E").otherwise("M")
    marks = F.transform(F.split("w", ""), lambda c, i: F.struct(c.alias("c"), place(i).alias("s")))
    # A table of one row a state and character.
    shown = counted.select("n", F.inline(marks)).groupBy("s", "c").agg(F.sum("n").alias("n")).collect()
    sums = {s: sum(r["n"] for r in shown if r["s"] == s) for s in STATES}
    shows = {s: {r["c"]: math.log(r["n"] / sums[s]) for r in shown if r["s"] == s} for s in STATES}
    total = sums["B"] + sums["S"]
    if not total:
        return Segmenter({})
    log = lambda x: math.log(x) if x > 0 else NEVER
    start = {"B": log(sums["B"] / total), "S": log(sums["S"] / total)}
    pairs = counted.where(size == 2).agg(F.sum("n")).first()[0] or 0
    moves = {("E", s): start[s] for s in start} | {("S", s): start[s] for s in start}
    if sums["B"]:
        # Behind a word's begin comes its end in words of two; a middle ends once in a longer word.
        moves |= {("B", "E"): log(pairs / sums["B"]), ("B", "M"): log(1 - pairs / sums["B"])}
    if sums["M"]:
        ends = (sums["B"] - pairs) / sums["M"]
        moves |= {("M", "E"): log(ends), ("M", "M"): log(1 - ends)}
    return Segmenter(held, start, moves, shows)


def segmented(df: DataFrame, segmenter: Segmenter, text: str = "text", words: str = "words") -> DataFrame:
    """Add the words of a text. The model is broadcast: its size is bounded where it is trained."""
    shared = df.sparkSession.sparkContext.broadcast(segmenter)

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for batch in batches:
            yield pa.array([None if t is None else model.segment(t) for t in batch.to_pylist()], pa.list_(pa.string()))

    work.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn(words, arrow_udf(work, "array<string>")(F.col(f"`{text}`")))
