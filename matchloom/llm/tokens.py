"""Token ids of whole texts by a public tokenizer file."""

from __future__ import annotations

import re
import struct
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from matchloom.llm.common import renamed

CACHED_WORDS = 400_000
TOKENS_SCHEMA = "id long, ids binary, tokens long"
# Up to here every letter is composed and has one lower-case form, whatever stands beside it.
_PLAIN = "ɐ"
# The units of the tokenizer's pre-tokenizer, for lower-case ASCII without blanks.
_UNITS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for
    themselves, the others, in order, for the code points from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(rest)) for b in range(256)}


def _ends_in_letter(core: str) -> bool:
    """Whether a letter or a number is last after normalising: some letters become one with a mark behind it."""
    return unicodedata.normalize("NFC", core).lower()[-1].isalnum()


class WordIds(dict):
    """The ids of a word as little-endian unsigned 32-bit numbers.

    For a tokenizer that drops white space and looks at each word alone, the ids of a text are those of
    its blank-separated pieces one after the other. Pieces are looked up in a bounded cache. A new one of
    printable ASCII is cut into the units of the pre-tokenizer, which go to the vocabulary model directly;
    of any other, trailing stops and commas are cut off where a letter or a number stands before them (a run
    of other marks is one unit), and what is not of plain letters goes through the whole tokenizer.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self._tokenizer, self._model, self._letters = tokenizer, tokenizer.model, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        if "<|" in word:  # perhaps a special token, which has an id of its own
            made = self._whole(word)
        elif word.isascii():
            made = self._ascii(word)
        elif (core := word.rstrip(".,")) != word and _ends_in_letter(core):
            return self[core] + self[word[len(core) :]]
        elif not word.isalpha() or max(word) >= _PLAIN or "İ" in word:
            made = self._whole(word)
        elif (lower := word.lower()) != word:
            return self[lower]
        else:
            made = self._unit(word.encode().decode("latin-1").translate(self._letters))
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = made
        return made

    def _ascii(self, word: str) -> bytes:
        if not word.isprintable():
            return self._whole(word)
        units = _UNITS.findall(word.lower())
        return self._unit(units[0]) if units == [word] else b"".join(map(self.__getitem__, units))

    def _unit(self, spelt: str) -> bytes:
        ids = [t.id for t in self._model.tokenize(spelt)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _whole(self, piece: str) -> bytes:
        ids = self._tokenizer.encode(piece, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def text(self, text: str) -> bytes:
        spaced = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        return b"".join(map(self.__getitem__, spaced.split(" ")))


@lru_cache(maxsize=1)
def word_tokenizer(file_text: str) -> WordIds:
    """Kept by the worker process, so that its later tasks find the tokenizer loaded."""
    from tokenizers import Tokenizer

    return WordIds(Tokenizer.from_str(file_text))


def tokenized(
    docs: DataFrame, tokenizer_path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, ids, tokens`` of every whole text, the ids as little-endian unsigned 32-bit numbers, followed
    by ``end_id`` if given. The tokenizer's file is read by the caller's process and travels with the task.

    A null text is an empty one (its ids are ``end_id`` alone); ids may be null or repeat; extra columns
    are not looked at; an empty table gives no rows. The string of a special token in a text is that token.
    """
    return renamed(docs, id=id_col, text=text_col).mapInArrow(encoder(tokenizer_path, end_id), TOKENS_SCHEMA)


def encoder(
    tokenizer_path: str, end_id: int | None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Turns batches ``id, text`` into ``id, ids, tokens``. A task forgets its words when it ends: a worker that
    waits for its next task holds the tokenizer alone."""
    with open(tokenizer_path, encoding="utf-8") as f:
        file_text = f.read()
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokenizer(file_text)
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, 500):
                    part = batch.slice(start, 500)
                    ids = [words.text(t or "") + end for t in part.column(1).to_pylist()]
                    counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                    made = [part.column(0).cast(pa.int64()), pa.array(ids, pa.binary()), counts]
                    yield pa.RecordBatch.from_arrays(made, ["id", "ids", "tokens"])
        finally:
            words.clear()
            pa.default_memory_pool().release_unused()

    return encode
