"""Repeated windows of words, counted by super-k-mer partitioning.

Consecutive windows that share a minimiser (the least hash of the ten-word runs in them) travel as one packed
string to the minimiser's bucket; there the windows of the strings are sorted and counted.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import cached_property
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame

from matchloom.llm import repeats

WINDOW, MINIMISER = 35, 10


class Words(repeats.Symbols):
    """Words without regard to the white space between them: single blanks join them here. Words that share
    a checksum may share a minimiser, no more: windows are compared by their bytes."""

    def __init__(self, text: bytes):
        self.words = text.split()  # of bytes: at \x20 and \x09-\x0D
        self.values = np.fromiter(map(zlib.crc32, self.words), np.uint64, len(self.words))

    @cached_property
    def joined(self) -> bytes:
        return b" ".join(self.words)

    @cached_property
    def _ends(self) -> np.ndarray:
        return np.cumsum(np.fromiter(map(len, self.words), np.int64, len(self.words)) + 1) - 1

    def cut(self, a: int, b: int) -> bytes:
        return self.joined[int(self._ends[a - 1]) + 1 if a else 0 : int(self._ends[b - 1])]


def _windows_of(packed: bytes, window: int) -> list[bytes]:
    ends = [k for k, c in enumerate(packed) if c == 32] + [len(packed)]
    starts = [0] + [e + 1 for e in ends[:-1]]
    return [packed[starts[i] : ends[i + window - 1]] for i in range(len(ends) - window + 1)]


def _count(window: int) -> Callable[[list[tuple]], list[bytes | None]]:
    def resolve(rows: list[tuple]) -> list[bytes | None]:
        out: list[bytes | None] = []
        start = 0
        while start < len(rows):
            end = start
            while end < len(rows) and rows[end][0] == rows[start][0]:
                end += 1
            out += _bucket(rows[start:end], window)
            start = end
        return out

    return resolve


def _bucket(rows: list[tuple], window: int) -> list[bytes | None]:
    """For each packed string of a bucket one byte per window, 1 if the window occurs elsewhere too."""
    strings: dict[bytes, int] = {}
    for _, packed, n, _, _ in rows:
        strings[packed] = strings.get(packed, 0) + n
    if len(strings) == 1 and next(iter(strings.values())) > 1:
        n = rows[0][1].count(b" ") + 2 - window
        return [b"\x01" * n] * len(rows)
    found = sorted(
        (w, k, i, n) for k, (packed, n) in enumerate(strings.items()) for i, w in enumerate(_windows_of(packed, window))
    )
    marks = [bytearray(p.count(b" ") + 2 - window) for p in strings]
    start = 0
    while start < len(found):
        end, total = start, 0
        while end < len(found) and found[end][0] == found[start][0]:
            total += found[end][3]
            end += 1
        if total > 1:
            for _, k, i, _ in found[start:end]:
                marks[k][i] = 1
        start = end
    result = {p: bytes(m) if any(m) else None for p, m in zip(strings, marks, strict=True)}
    return [result[r[1]] for r in rows]


def remove_repeated(
    docs: DataFrame,
    window: int = WINDOW,
    minimiser: int = MINIMISER,
    id_col: str = "doc_id",
    text_col: str = "text",
    **limits: int,
) -> DataFrame:
    """``id, n_words, n_removed, kept`` of every whole text: the words left, joined by single blanks, when each
    word covered by a window of ``window`` words that also starts anywhere else (in any document,
    this one included) is taken out. Windows are judged on the input.

    A null or empty text has no words; a text shorter than a window loses none; of repeated rows and copies
    of a window or more all words go, in each of them; ids may be null or repeat; an empty table
    gives no rows; extra columns are not looked at. ``limits`` are those of ``repeats.search``.
    """

    def finish(doc: int | None, text: Words, found: list[tuple[int, int, bytes]]) -> tuple:
        words = text.words
        if not found:
            return doc, len(words), 0, text.joined.decode("utf-8", "replace")
        cover = np.zeros(len(words) + 1, dtype=np.int64)
        for a, _, marks in found:
            starts = np.flatnonzero(np.frombuffer(marks, dtype=np.uint8)) + a
            cover[starts] += 1
            cover[starts + window] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        kept = b" ".join(compress(words, (~gone).tolist()))
        return doc, len(words), int(gone.sum()), kept.decode("utf-8", "replace")

    kind = repeats.Windows(window, minimiser, Words, per_document=False)
    schema = "id long, n_words long, n_removed long, kept string"
    return repeats.search(docs, kind, _count(window), finish, schema, id_col, text_col, **limits)
