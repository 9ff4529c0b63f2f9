"""Text expressions; all run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom.functions.draws import hash_number

# What separates words: every character Python's str.split() splits at. Fixed values.
BLANKS = (
    r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)

# A place where a word can begin: the start of the text, or any character that
# is no letter, digit or underscore. Spelt out because engines differ on \b.
WORD_START = r"(^|[^\p{L}\p{N}_])"


def collapse_spaces(text: Column) -> Column:
    """Trim, then turn every run of two or more blanks into one space."""
    return F.regexp_replace(F.trim(text), r"\s{2,}", " ")


def join_text(*parts: Column) -> Column:
    """Join the parts by one space and clean up; nulls are skipped."""
    return collapse_spaces(F.concat_ws(" ", *parts))


def space_count(text: Column) -> Column:
    """Number of pieces between single spaces; null for null."""
    return F.size(F.split(text, " "))


def longest(columns: list[Column]) -> Column:
    """Number of pieces of the column that has most; 0 if all are null."""
    counts = [F.coalesce(space_count(c), F.lit(0)) for c in columns]
    return F.greatest(*counts) if len(counts) > 1 else counts[0]


def any_longer_than(columns: list[Column], words: int) -> Column:
    """True where one of the columns has more than ``words`` pieces."""
    return longest(columns) > words


def any_not_null(columns: list[Column]) -> Column:
    found = F.lit(False)
    for c in columns:
        found = found | c.isNotNull()
    return found


def mentions(text: Column, phrase: str) -> Column:
    """True where the pattern ``phrase`` occurs at the beginning of a word; a null
    text mentions nothing."""
    return F.coalesce(text.rlike(WORD_START + phrase), F.lit(False))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def drop_words(text: Column, n: int, seed: str, row_id: Column) -> Column:
    """Remove a word drawn by hash, ``n`` times, and join the rest by one space.

    Null, blank and too short texts stay as they are; a text of exactly ``n``
    words becomes empty. The draw depends on the seed, the row and the number of
    words only, so a retried task repeats it.
    """

    def without_one(words: Column, turn: int) -> Column:
        size = F.greatest(F.size(words), F.lit(1))
        at = (hash_number(seed, row_id, F.lit(turn)) % size).cast("int")
        return _let(at, lambda i: F.concat(F.slice(words, F.lit(1), i), F.slice(words, i + 2, size)))

    def rest(words: Column, turn: int) -> Column:
        if turn == n:
            return F.array_join(words, " ")
        return _let(without_one(words, turn), lambda left: rest(left, turn + 1))

    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    return _let(
        words, lambda ws: F.when(F.size(ws) >= max(n, 1), rest(ws, 0)).otherwise(text)
    )
