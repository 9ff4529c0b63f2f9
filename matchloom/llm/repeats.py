"""What the two searches for repeated windows share.

A window is a run of consecutive symbols (bytes or words) of one document. Its trigger is the least of the
rolling hashes of the short runs in it, so that equal windows have equal triggers wherever they stand.
Consecutive windows with one trigger form a phrase, which holds all of them. The search

1. deals the documents to chunks of bounded size and lists each chunk's triggers once,
2. keeps the triggers that occur again anywhere in the corpus,
3. sends the phrases of those triggers, each distinct one of a chunk once, to the trigger's task,
   where equal windows meet and are compared byte by byte,
4. returns to each chunk what was found of its phrases.

The chunks' texts are shuffled once and read three times. No task sees more of a trigger than a row per chunk,
or, where it is too frequent, than a row per chunk and window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import pieces_of, renamed

CHUNK_BYTES = 4 << 20
FREQUENT = 10_000  # a trigger with more occurrences is told apart by its windows

_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_PHRASES = "key long, fine boolean, trigger long, phrase binary, c int, n long, first long, last long"
_FOUND = "c int, trigger long, fine boolean, digest binary, found binary"


def rolling(values: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` values, from those of runs of doubling lengths."""
    whole, done, part, size = None, 0, values, 1
    while True:
        if length & size:
            if whole is None:
                whole, done = part, size
            else:
                n = max(0, len(values) - done - size + 1)
                whole, done = whole[:n] * _power(size) + part[done : done + n], done + size
        if 2 * size > length:
            break
        n = max(0, len(part) - size)
        part, size = part[:n] * _power(size) + part[size : size + n], 2 * size
    mixed = (whole ^ (whole >> np.uint64(32))) * _MIX
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _BASE
    return mixed ^ (mixed >> np.uint64(32))


def _power(k: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), k, 1 << 64))


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


class Symbols:
    """A text as an array of symbol hashes; ``cut`` gives the bytes of symbols ``a`` to ``b``."""

    values: np.ndarray

    def cut(self, a: int, b: int) -> bytes:
        raise NotImplementedError


@dataclass(frozen=True)
class Windows:
    """The kind of window: ``window`` symbols, triggers of ``trigger`` symbols, and how a text is read."""

    window: int
    trigger: int
    read: Callable[[bytes], Symbols]
    per_document: bool  # whether a repeat within one document counts

    @property
    def width(self) -> int:
        return self.window - self.trigger + 1

    def phrases(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First windows of the phrases (and, last, the number of windows), and their triggers."""
        if len(values) < self.window:
            return np.zeros(1, dtype=np.int64), np.empty(0, dtype=np.uint64)
        low = least(rolling(values, self.trigger), self.width)
        starts = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
        return np.append(starts, len(low)), low[starts]

    def triggers(self, values: np.ndarray) -> np.ndarray:
        """The triggers of a text, one for each place where it stands: a place is a trigger's if the hash
        there is the least of some window, the greatest of such least ones that it lies in."""
        if len(values) < self.window:
            return np.empty(0, dtype=np.uint64)
        hashes = rolling(values, self.trigger)
        low = least(hashes, self.width)
        none = np.zeros(self.width - 1, dtype=np.uint64)
        reach = ~least(~np.concatenate([none, low, none]), self.width)
        found = hashes[reach == hashes]
        return np.unique(found) if self.per_document else found


def documents(table: pa.Table) -> Iterator[tuple[int | None, bytes]]:
    texts = table.column("text").cast(pa.binary())
    for key, text in zip(table.column("id").to_pylist(), texts, strict=True):
        yield key, text.as_py() or b""


def _digest(phrase: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(phrase)


def fine_key(phrase: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(phrase) - (1 << 63)


def order_of(key: int | None) -> int:
    """The place of an id in the order of documents; one without an id comes after all others."""
    return (1 << 63) - 1 if key is None else key


def positions(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions of ``wanted`` in ``sorted_values``, -1 where it is not there."""
    at = np.searchsorted(sorted_values, wanted)
    at[at == len(sorted_values)] = 0
    return np.where(sorted_values[at] == wanted, at, -1) if len(sorted_values) else np.full(len(wanted), -1)


def text_bytes(docs: DataFrame, text_col: str) -> int:
    return renamed(docs, text=text_col).agg(F.sum(F.octet_length("text"))).first()[0] or 0


def chunks_of(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int, total: int | None = None) -> DataFrame:
    """``id, text, c``: the documents dealt to chunks ``c`` by a hash of id and text; ``total`` is the ``text_bytes`` of
    all, if known."""
    rows = renamed(docs, id=id_col, text=text_col)
    wanted = pieces_of(text_bytes(docs, text_col) if total is None else total, chunk_bytes)
    chunk = F.pmod(F.xxhash64("id", "text"), F.lit(wanted)).cast("int")
    return rows.select(F.col("id").cast("long").alias("id"), "text", chunk.alias("c")).repartition("c")


def shared_triggers(chunks: DataFrame, windows: Windows) -> DataFrame:
    """``c, trigger, total``: the triggers of each chunk that stand in more than one place (or document)."""

    def list_triggers(key: tuple, table: pa.Table) -> pa.Table:
        found = [windows.triggers(windows.read(text).values) for _, text in documents(table)]
        values, counts = np.unique(np.concatenate(found), return_counts=True)
        c = np.full(len(values), key[0].as_py(), dtype=np.int32)
        return pa.table({"trigger": values.view(np.int64), "c": c, "n": counts.astype(np.int64)})

    listed = chunks.groupBy("c").applyInArrow(list_triggers, "trigger long, c int, n long")
    total = F.sum("n").over(Window.partitionBy("trigger"))
    return listed.withColumn("total", total).filter("total > 1").select("c", "trigger", "total")


def sorted_triggers(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The triggers of a chunk in order, and the positions that order them."""
    triggers = table.column("trigger").to_numpy().view(np.uint64)
    order = np.argsort(triggers)
    return triggers[order], order


Phrases = tuple[np.ndarray, np.ndarray]


def phrases_of(
    windows: Windows, symbols: Symbols, wanted: np.ndarray, phrases: Phrases | None = None
) -> Iterator[tuple[int, int, int]]:
    """First window, last window + 1 and position in ``wanted`` of the phrases whose trigger is there; ``phrases`` are
    those of the text, if known."""
    bounds, triggers = windows.phrases(symbols.values) if phrases is None else phrases
    at = positions(wanted, triggers)
    for k in np.flatnonzero(at >= 0):
        yield int(bounds[k]), int(bounds[k + 1]), int(at[k])


def send_phrases(chunks: DataFrame, shared: DataFrame, windows: Windows, frequent: int) -> DataFrame:
    """The phrases of the triggers in ``shared`` (c, trigger, total), each distinct one of a chunk once, with how
    often it is there and in which first and last document; of a frequent trigger, its windows one by one."""

    def send(key: tuple, table: pa.Table, triggers: pa.Table) -> pa.Table:
        wanted, order = sorted_triggers(triggers)
        totals = triggers.column("total").to_numpy()[order]
        seen: dict[tuple, list] = {}
        for doc, text in documents(table) if len(wanted) else ():
            place, symbols = order_of(doc), windows.read(text)
            for a, b, at in phrases_of(windows, symbols, wanted):
                trigger, fine = int(wanted[at].view(np.int64)), bool(totals[at] > frequent)
                spans = ((i, i + 1) for i in range(a, b)) if fine else ((a, b),)
                for i, j in spans:
                    phrase = symbols.cut(i, j - 1 + windows.window)
                    mine = (fine_key(phrase) if fine else trigger, fine, trigger, phrase)
                    if (known := seen.get(mine)) is None:
                        seen[mine] = [1, place, place]
                    else:
                        known[0] += 1
                        known[1], known[2] = min(known[1], place), max(known[2], place)
        return table_of([(*k, key[0].as_py(), *v) for k, v in seen.items()], _PHRASES)

    return chunks.groupBy("c").cogroup(shared.groupBy("c")).applyInArrow(send, _PHRASES)


def compare_phrases(sent: DataFrame, resolve: Callable[[list[tuple]], list[bytes | None]]) -> DataFrame:
    """What ``resolve`` finds for whole key groups of rows (key, phrase, n, first, last), sorted by key and phrase;
    rows for which it returns None are left out."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def ready(group: list[dict]) -> list[pa.RecordBatch]:
            found = resolve([(r["key"], r["phrase"], r["n"], r["first"], r["last"]) for r in group])
            made = [
                (r["c"], r["trigger"], r["fine"], _digest(r["phrase"]), x)
                for r, x in zip(group, found, strict=True)
                if x is not None
            ]
            return table_of(made, _FOUND).to_batches()

        for batch in batches:
            held += batch.to_pylist()
            last = held[-1]["key"] if held else None
            edge = len(held)
            while edge and held[edge - 1]["key"] == last:
                edge -= 1
            if edge:
                yield from ready(held[:edge])
                held = held[edge:]
        if held:
            yield from ready(held)

    return sent.repartition("key").sortWithinPartitions("key", "phrase").mapInArrow(compare, _FOUND)


class Known:
    """What was found of a chunk's phrases."""

    def __init__(self, windows: Windows, results: pa.Table):
        self._windows = windows
        rows = results.select(["digest", "found"]).to_pylist()
        self._found = {r["digest"]: r["found"] for r in rows}
        triggers = results.column("trigger").to_numpy().view(np.uint64)
        self._wanted, first = np.unique(triggers, return_index=True)
        self._fine = results.column("fine").to_numpy(zero_copy_only=False)[first]

    def of(self, symbols: Symbols, phrases: Phrases | None = None) -> list[tuple[int, int, bytes]]:
        """(first window, last window + 1, found) of the text's phrases of which something was found."""
        out, window = [], self._windows.window
        for a, b, at in phrases_of(self._windows, symbols, self._wanted, phrases) if len(self._wanted) else ():
            for i, j in ((i, i + 1) for i in range(a, b)) if self._fine[at] else ((a, b),):
                result = self._found.get(_digest(symbols.cut(i, j - 1 + window)))
                if result is not None:
                    out.append((i, j, result))
        return out


def search(
    docs: DataFrame,
    windows: Windows,
    resolve: Callable[[list[tuple]], list[bytes | None]],
    finish: Callable[[int | None, Symbols, list[tuple[int, int, bytes]]], tuple],
    schema: str,
    id_col: str,
    text_col: str,
    chunk_bytes: int = CHUNK_BYTES,
    frequent: int = FREQUENT,
) -> DataFrame:
    """Rows of ``schema`` that ``finish`` makes of every document: of its id, its symbols and what
    ``resolve`` found of its phrases, as ``Known.of`` lists it."""
    chunks = chunks_of(docs, id_col, text_col, chunk_bytes)
    sent = send_phrases(chunks, shared_triggers(chunks, windows), windows, frequent)

    def apply(key: tuple, table: pa.Table, results: pa.Table) -> pa.Table:
        known = Known(windows, results)
        read = ((doc, windows.read(text)) for doc, text in documents(table))
        return table_of([finish(doc, symbols, known.of(symbols)) for doc, symbols in read], schema)

    found = compare_phrases(sent, resolve)
    return chunks.groupBy("c").cogroup(found.groupBy("c")).applyInArrow(apply, schema)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}


def table_of(rows: list[tuple], schema: str) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.table({name: pa.array(c, _TYPES[kind]) for (name, kind), c in zip(fields, columns, strict=True)})
