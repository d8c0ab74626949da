"""Text expressions and the tokenizers that need no vocabulary file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ids of special tokens start above the Unicode range, so they never meet a code point.
SPECIAL = 0x110000
BOS_ID, EOS_ID, PAD_ID, TEXT_END_ID, MEDIA_ID = (SPECIAL + i for i in range(5))
IGNORE = -100


def bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of a value that is computed once, however often ``make`` reads it.

    A fold over nothing: unlike a transformed element, what ``make`` returns is not copied.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, make)


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def replace_first(text: Column, old: str, new: Column) -> Column:
    """The first occurrence of a literal replaced."""
    at = F.locate(old, text)
    after = F.substring(text, at + len(old), F.length(text))
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), new, after)).otherwise(text)


def hash_order(seed: int | str, *keys: Column) -> Column:
    """A text whose order shuffles rows reproducibly in any engine that has md5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys)))


def char_ids(text: Column) -> Column:
    """One id a code point."""
    return F.when(F.length(text) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.split(text, ""), lambda c: F.ascii(c)))


def word_ids(text: Column, vocabulary: int = 50_000) -> Column:
    """One id a white-space separated word: a hash modulo the vocabulary."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(vocabulary)).cast("int"))


def count_of(text: Column, part: str) -> Column:
    """Occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def python_round(x: Column, digits: int) -> Column:
    """Rounding to even on ties."""
    return F.bround(x, digits)


def log_sigmoid(x: Column) -> Column:
    return -(F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))
