"""Repeated byte strings by prefix-free parsing.

Rolling-hash triggers cut the texts into phrases. The distinct phrases are the dictionary, the sequence of
phrases of each document is the parse. The suffixes of the dictionary are sorted once, however often a phrase
occurs, and the parse says in which documents each of them starts. The trigger is the least rolling hash of
a stretch, not one that is zero modulo some number, so that no string as long as is searched for is without
one; and a phrase carries what follows it up to that length, so that the sorted suffixes of the dictionary
are the order of the corpus to that depth, and the parse need not be sorted for what lies beyond.

Chunks of documents and buckets of triggers exchange arrays, a row for each chunk and bucket that have to do with
one another: first only the triggers, answered by one bit each that says whether a trigger stands in another document
too; then, of those that do, a hash of the phrase and its first and last document, answered by what is to be done.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from matchloom.llm import repeats

LENGTH, TRIGGER = 50, 24
BUCKET_KEYS = 1 << 18  # triggers that one bucket tells apart, about

_NOTHING, _ALIKE, _SEVERAL, _FREQUENT = range(4)

# One 64-bit number per byte, from the golden ratio by multiplication.
_BYTES = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class Keyed(repeats.Windows):
    """Windows whose triggers are told apart by a key of 32 + ``bits`` bits, of which the first ``bits`` are the bucket.
    Triggers that share a key are taken for one trigger with several phrases."""

    bits: int

    def phrases(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bounds, triggers = super().phrases(values)
        # Triggers are least hashes, so their first bits are not even.
        even = (triggers ^ (triggers >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        return bounds, (even ^ (even >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32 - self.bits)


class Bytes(repeats.Symbols):
    def __init__(self, text: bytes):
        self.text = text
        self.values = _BYTES[np.frombuffer(text, dtype=np.uint8)]

    def cut(self, a: int, b: int) -> bytes:
        return self.text[a:b]


def suffix_runs(phrases: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of at least ``depth`` bytes of all phrases, one behind the other, as ``(order, run)``:
    the suffix array to that depth, and for each entry the number of its run of equal ones."""
    text = np.frombuffer(b"".join(phrases), dtype=np.uint8)
    lengths = np.array([len(p) for p in phrases])
    counts = lengths - depth + 1
    begins = np.repeat(np.cumsum(lengths) - lengths, counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    width = -(-depth // 8) * 8
    letters = np.zeros((len(begins), width), dtype=np.uint8)
    letters[:, :depth] = np.lib.stride_tricks.sliding_window_view(text, depth)[begins + inside]
    keys = letters.view(">u8")
    order = np.lexsort(keys.T[::-1])
    ranked = keys[order]
    new = np.append(True, (ranked[1:] != ranked[:-1]).any(axis=1)) if len(order) else np.empty(0, dtype=bool)
    return order, np.cumsum(new) - 1


def _first_documents(depth: int) -> Callable[[list[tuple]], list[bytes | None]]:
    def resolve(rows: list[tuple]) -> list[bytes | None]:
        """For each phrase the first document of every string that starts in it, as 64-bit numbers (a single one
        if it is the same for all); None if none of them comes before the phrase's last document."""
        entries: dict[tuple, int] = {}
        for key, phrase, _, first, _ in rows:
            entries[key, phrase] = min(first, entries.get((key, phrase), first))
        variants: dict[int, int] = {}
        for key, _ in entries:
            variants[key] = variants.get(key, 0) + 1
        mixed = [e for e in entries if variants[e[0]] > 1]
        known = {}
        if mixed:
            counts = np.array([len(p) - depth + 1 for _, p in mixed])
            firsts = np.repeat(np.array([entries[e] for e in mixed], dtype=np.int64), counts)
            order, run = suffix_runs([p for _, p in mixed], depth)
            least = np.minimum.reduceat(firsts[order], np.flatnonzero(np.append(True, run[1:] != run[:-1])))
            best = np.empty(len(order), dtype=np.int64)
            best[order] = least[run]
            ends = np.cumsum(counts)
            known = {e: best[end - n : end] for e, n, end in zip(mixed, counts, ends, strict=True)}
        out: list[bytes | None] = []
        for key, phrase, _, _, last in rows:
            best = known.get((key, phrase))
            if best is None:
                first = entries[key, phrase]
                out.append(None if first >= last else first.to_bytes(8, "little", signed=True))
            elif (best >= last).all():
                out.append(None)
            else:
                out.append((best[:1] if (best == best[0]).all() else best).astype("<i8").tobytes())
        return out

    return resolve


def phrase_hashes(windows: repeats.Windows, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each phrase's content: of the hashes of all strings that start in it and of their number."""
    strings = repeats.rolling(values, windows.window)
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(strings, dtype=np.uint64)])
    a, b = bounds[:-1], bounds[1:]
    sums = total[b] - total[a] + (b - a).astype(np.uint64)
    mixed = (sums ^ (sums >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed ^ (mixed >> np.uint64(32))) + strings[a] * np.uint64(0x9E3779B97F4A7C15)


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers as bytes, the lowest bytes of all first, so that the zeros in front compress."""
    width = numbers.dtype.itemsize
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, width).T.tobytes()


def _unpacked(packed: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(packed, dtype=np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _joined(parts: list[np.ndarray], kind: str) -> np.ndarray:
    return np.concatenate([np.empty(0, dtype=kind), *parts])


def _split(values: np.ndarray, parts: list[np.ndarray]) -> list[np.ndarray]:
    """What belongs to each of ``parts``, of which ``values`` has an entry for each entry."""
    return np.split(values, np.cumsum([len(p) for p in parts])[:-1]) if parts else []


def _buckets(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The buckets of sorted keys and where they are."""
    if len(keys):
        bucket = keys >> np.uint64(32)
        edges = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(keys)]])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield int(bucket[a]), slice(int(a), int(b))


_KEYS = "b int, c int, keys binary, own binary"
_SHARED = "b int, c int, shared binary"
_LISTED = "b int, c int, keys binary, phrase binary, first binary, span binary, n binary"
_TOLD = "b int, c int, keys binary, code binary, best binary"
_SENT = "key long, fine boolean, trigger long, phrase binary, c int, n long, first long, last long"


def _shared_keys(chunks: DataFrame, windows: Keyed) -> DataFrame:
    """For each chunk and bucket a bit for each key in order: whether it stands in more than one document."""

    def list_keys(key: tuple, table: pa.Table) -> pa.Table:
        found = [np.unique(windows.phrases(windows.read(text).values)[1]) for _, text in repeats.documents(table)]
        keys, counts = np.unique(np.concatenate(found), return_counts=True)
        c, low = key[0].as_py(), keys.astype(np.uint32)
        rows = [(b, c, _packed(low[at]), np.packbits(counts[at] > 1).tobytes()) for b, at in _buckets(keys)]
        return repeats.table_of(rows, _KEYS)

    def mark(key: tuple, table: pa.Table) -> pa.Table:
        parts = [_unpacked(x, "<u4") for x in table.column("keys").to_pylist()]
        owns = zip(table.column("own").to_pylist(), parts, strict=True)
        own = _joined([np.unpackbits(np.frombuffer(o, np.uint8), count=len(p)) for o, p in owns], "u1") > 0
        _, of, counts = np.unique(_joined(parts, "<u4"), return_inverse=True, return_counts=True)
        shared = counts > 1
        shared[of[own]] = True
        bits = [np.packbits(x).tobytes() for x in _split(shared[of], parts)]
        rows = [(key[0].as_py(), c, x) for c, x in zip(table.column("c").to_pylist(), bits, strict=True)]
        return repeats.table_of(rows, _SHARED)

    return chunks.groupBy("c").applyInArrow(list_keys, _KEYS).groupBy("b").applyInArrow(mark, _SHARED)


def _listed_phrases(chunks: DataFrame, shared: DataFrame, windows: Keyed) -> DataFrame:
    """The parse of each chunk, as far as its keys are shared: for each key the hash of its phrase, 0 if it has several
    in the chunk, the first and the last document and the number of places."""

    def parse(chunk: tuple, table: pa.Table, shared: pa.Table) -> pa.Table:
        read = []
        for doc, text in repeats.documents(table):
            bounds, keys = windows.phrases(windows.read(text).values)
            read.append((doc, text, bounds, keys))
        all_keys = np.unique(_joined([keys for *_, keys in read], "u8"))
        bits = dict(zip(shared.column("b").to_pylist(), shared.column("shared").to_pylist(), strict=True))
        flags = [
            np.unpackbits(np.frombuffer(bits[b], np.uint8), count=at.stop - at.start) for b, at in _buckets(all_keys)
        ]
        wanted = all_keys[_joined(flags, "u1") > 0]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for doc, text, bounds, keys in read:
            here = repeats.positions(wanted, keys) >= 0
            if here.any():
                place = np.full(int(here.sum()), repeats.order_of(doc), dtype=np.int64)
                found.append((keys[here], phrase_hashes(windows, windows.read(text).values, bounds)[here], place))
        if not found:
            return repeats.table_of([], _LISTED)
        key, phrase, place = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((phrase, key))
        key, phrase, place = key[order], phrase[order], place[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        ends = np.append(starts[1:], len(key))
        one = np.where(phrase[starts] == phrase[ends - 1], phrase[starts], np.uint64(0))
        first = np.minimum.reduceat(place, starts)
        span = np.maximum.reduceat(place, starts) - first
        n, key, c = (ends - starts).astype(np.uint32), key[starts], chunk[0].as_py()
        low = key.astype(np.uint32)
        rows = [(b, c, *(_packed(x[at]) for x in (low, one, first, span, n))) for b, at in _buckets(key)]
        return repeats.table_of(rows, _LISTED)

    return chunks.groupBy("c").cogroup(shared.groupBy("c")).applyInArrow(parse, _LISTED)


def _told(listed: DataFrame, frequent: int) -> DataFrame:
    """For each chunk and bucket the keys of which something is to be removed or compared: those with one phrase, with
    its first document where that comes before the chunk's last; those with several; of these, the frequent ones."""

    def tell(key: tuple, table: pa.Table) -> pa.Table:
        kinds = {"keys": "<u4", "phrase": "<u8", "first": "<i8", "span": "<i8", "n": "<u4"}
        parts = {name: [_unpacked(x, k) for x in table.column(name).to_pylist()] for name, k in kinds.items()}
        keys, phrase, first, span, n = (_joined(parts[name], k) for name, k in kinds.items())
        order = np.argsort(keys, kind="stable")
        new = np.append(True, keys[order][1:] != keys[order][:-1])
        starts, of = np.flatnonzero(new), np.empty(len(keys), dtype=np.int64)
        of[order] = np.cumsum(new) - 1
        low, high = np.minimum.reduceat(phrase[order], starts), np.maximum.reduceat(phrase[order], starts)
        several = ((low != high) | (low == 0))[of]
        often = (np.add.reduceat(n[order].astype(np.int64), starts) > frequent)[of]
        best = np.minimum.reduceat(first[order], starts)[of]
        code = np.where(best < first + span, _ALIKE, _NOTHING)
        code = np.where(several, np.where(often, _FREQUENT, _SEVERAL), code).astype(np.uint8)
        best[several] = 0
        rows = []
        for c, *mine in zip(
            table.column("c").to_pylist(), *(_split(x, parts["keys"]) for x in (keys, code, best)), strict=True
        ):
            some = mine[1] != _NOTHING
            if some.any():
                rows.append((key[0].as_py(), c, *(_packed(x[some]) for x in mine)))
        return repeats.table_of(rows, _TOLD)

    return listed.groupBy("b").applyInArrow(tell, _TOLD)


def _told_here(told: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of one chunk in order, what is to be done and the first documents."""
    rows = sorted(told.select(["b", "keys", "code", "best"]).to_pylist(), key=lambda r: r["b"])
    keys = [_unpacked(r["keys"], "<u4").astype(np.uint64) | np.uint64(r["b"] << 32) for r in rows]
    code, best = ([_unpacked(r[name], kind) for r in rows] for name, kind in (("code", "u1"), ("best", "<i8")))
    return _joined(keys, "u8"), _joined(code, "u1"), _joined(best, "<i8")


def _sent_phrases(chunks: DataFrame, told: DataFrame, windows: Keyed) -> DataFrame:
    """The phrases of the keys that have several, each distinct one of a chunk once, with its first and last document;
    of a frequent key, the strings one by one."""

    def send(chunk: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        keys, code, _ = _told_here(told)
        wanted, fine_key = keys[code >= _SEVERAL], code[code >= _SEVERAL] == _FREQUENT
        seen: dict[tuple, list] = {}
        for doc, text in repeats.documents(table) if len(wanted) else ():
            place, symbols = repeats.order_of(doc), windows.read(text)
            for a, b, at in repeats.phrases_of(windows, symbols, wanted):
                trigger, fine = int(wanted[at]), bool(fine_key[at])
                for i, j in ((i, i + 1) for i in range(a, b)) if fine else ((a, b),):
                    phrase = symbols.cut(i, j - 1 + windows.window)
                    mine = repeats.fine_key(phrase) if fine else trigger, fine, trigger, phrase
                    if (known := seen.get(mine)) is None:
                        seen[mine] = [place, place]
                    else:
                        known[0], known[1] = min(known[0], place), max(known[1], place)
        return repeats.table_of([(*k, chunk[0].as_py(), 1, *v) for k, v in seen.items()], _SENT)

    return chunks.groupBy("c").cogroup(told.groupBy("c")).applyInArrow(send, _SENT)


def remove_repeated(
    docs: DataFrame,
    length: int = LENGTH,
    trigger: int = TRIGGER,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_bytes: int = repeats.CHUNK_BYTES,
    frequent: int = repeats.FREQUENT,
    bucket_keys: int = BUCKET_KEYS,
) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept`` of every whole text as UTF-8: what is left when each byte is
    taken out that is covered by a string of ``length`` bytes which also starts in a document with a smaller
    id. Matches never cross documents, overlap as they may, and are judged on the input.

    The parse goes ahead of the dictionary: where all phrases of a trigger are one, by their 64-bit hash and
    trigger, its first document is that of every string in it and no bytes are sent. Only the phrases of
    triggers that have several go to the dictionary, and those of frequent triggers string by string.

    A null or empty text has no bytes; one shorter than ``length`` loses none; a row without an id comes
    after all others, and repeated rows or rows with one id are not before each other; an empty table
    gives no rows; extra columns are not looked at.
    """
    total = repeats.text_bytes(docs, text_col)
    places = 2 * total // (length - trigger + 2)
    windows = Keyed(length, trigger, Bytes, per_document=True, bits=min(31, (places // bucket_keys).bit_length()))
    chunks = repeats.chunks_of(docs, id_col, text_col, chunk_bytes, total)
    told = _told(_listed_phrases(chunks, _shared_keys(chunks, windows), windows), frequent)
    found = repeats.compare_phrases(_sent_phrases(chunks, told, windows), _first_documents(length))
    results = found.unionByName(told, allowMissingColumns=True)
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept binary"

    def finish(doc: int | None, text: bytes, alike: tuple, known: repeats.Known) -> tuple:
        if len(text) < length:
            return doc, len(text), 0, 0, text
        place, symbols = repeats.order_of(doc), Bytes(text)
        cover = np.zeros(len(text) + 1, dtype=np.int32)
        bounds, keys = windows.phrases(symbols.values)
        if len(alike[0]):
            at = repeats.positions(alike[0], keys)
            gone = np.flatnonzero((at >= 0) & (alike[1][at] < place))
            cover[bounds[gone]] += 1
            cover[bounds[gone + 1] - 1 + length] -= 1
        for a, b, packed in known.of(symbols, (bounds, keys)):
            if len(packed) == 8:  # one first document for all
                if int.from_bytes(packed, "little", signed=True) < place:
                    cover[a] += 1
                    cover[b - 1 + length] -= 1
                continue
            firsts = np.frombuffer(packed, dtype="<i8")
            starts = np.flatnonzero(firsts < place) + a
            cover[starts] += 1
            cover[starts + length] -= 1
        if not cover.any():
            return doc, len(text), 0, 0, text
        gone = np.cumsum(cover[:-1]) > 0
        kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1).sum())
        return doc, len(text), int(gone.sum()), spans, kept

    def apply(key: tuple, table: pa.Table, results: pa.Table) -> pa.Table:
        told = pc.is_valid(results.column("code"))
        known = repeats.Known(windows, results.filter(pc.invert(told)))
        keys, code, best = _told_here(results.filter(told))
        alike = keys[code == _ALIKE], best[code == _ALIKE]
        rows = [finish(doc, text, alike, known) for doc, text in repeats.documents(table)]
        return repeats.table_of(rows, schema)

    return chunks.groupBy("c").cogroup(results.groupBy("c")).applyInArrow(apply, schema)
