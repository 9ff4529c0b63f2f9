"""Vector bin packing of examples into training sequences.

A sequence has three limits at once: tokens, segments and loss-bearing tokens. It is filled by the
dot-product heuristic: of the waiting examples that fit, the one whose needs, each as a share of its limit,
point most in the direction of what is left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm import tokens
from matchloom.llm.common import renamed

POOL = 1024
PIECES_SCHEMA = (
    "id long, start long, length long, ids binary, doc_tokens long, loss long, sequence_id long, offset long"
)


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 64
    loss_tokens: int = 4096


@dataclass
class Piece:
    """Tokens ``start`` to ``start + length`` of an example; the last ``loss`` of them bear loss."""

    id: int | None
    start: int
    length: int
    loss: int
    ids: memoryview
    total: int

    def cut(self, length: int) -> tuple[Piece, Piece]:
        head_loss = max(0, length - (self.length - self.loss))
        head = Piece(self.id, self.start, length, head_loss, self.ids[: 4 * length], self.total)
        tail = Piece(
            self.id, self.start + length, self.length - length, self.loss - head_loss,
            self.ids[4 * length :], self.total,
        )
        return head, tail

    def longest(self, tokens: int, loss: int) -> int:
        """How many of its first tokens keep to both limits."""
        return max(0, min(self.length, tokens, self.length - self.loss + loss))


class Packer:
    """Packs a stream of pieces, holding at most ``pool`` waiting ones. Every sequence starts with
    the piece that has waited longest, so that none is passed over for good and the order of the stream is
    kept to within the pool."""

    def __init__(self, limits: Limits, cut: bool, pool: int):
        self.limits, self.can_cut, self.pool = limits, cut, pool
        self.waiting: list[Piece | None] = []
        self.needs = np.empty((0, 2))
        self.alive = 0

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        limits = self.limits
        if not self.can_cut and (piece.length > limits.tokens or piece.loss > limits.loss_tokens):
            raise ValueError(f"example {piece.id} is beyond the limits and must not be cut")
        while piece.length > limits.tokens or piece.loss > limits.loss_tokens:
            head, piece = piece.cut(piece.longest(limits.tokens, limits.loss_tokens))
            yield [head]
        self._append(piece)
        if self.alive >= self.pool:
            yield self._fill()

    def finish(self) -> Iterator[list[Piece]]:
        while self.alive:
            sequence = self._fill()
            yield from self._powers(sequence) if self.can_cut and not self.alive else [sequence]

    def _append(self, piece: Piece) -> None:
        if len(self.waiting) >= len(self.needs):
            kept = [p for p in self.waiting if p is not None]
            self.needs = np.full((max(64, 2 * len(kept)), 2), np.inf)
            self.waiting = kept
            for k, p in enumerate(kept):
                self.needs[k] = p.length, p.loss
        self.needs[len(self.waiting)] = piece.length, piece.loss
        self.waiting.append(piece)
        self.alive += 1

    def _take(self, k: int) -> Piece:
        piece = self.waiting[k]
        self.waiting[k] = None
        self.needs[k] = np.inf
        self.alive -= 1
        return piece

    def _put_back(self, k: int, piece: Piece) -> None:
        self.waiting[k] = piece
        self.needs[k] = piece.length, piece.loss
        self.alive += 1

    def _fill(self) -> list[Piece]:
        limits = self.limits
        oldest = next(k for k, p in enumerate(self.waiting) if p is not None)
        sequence = [self._take(oldest)]
        tokens, loss = limits.tokens - sequence[0].length, limits.loss_tokens - sequence[0].loss
        if oldest:  # nothing waits before it
            del self.waiting[:oldest]
            self.needs = self.needs[oldest:]
        needs = self.needs[: len(self.waiting)]
        while self.alive and tokens > 0 and len(sequence) < limits.segments:
            fits = (needs[:, 0] <= tokens) & (needs[:, 1] <= loss)
            found = np.flatnonzero(fits)
            if not len(found):
                break
            # The segment's share is alike for all of them and decides nothing.
            toward = needs[found, 0] * (tokens / limits.tokens**2) + needs[found, 1] * (
                loss / max(1, limits.loss_tokens) ** 2
            )
            piece = self._take(found[int(toward.argmax())])
            sequence.append(piece)
            tokens, loss = tokens - piece.length, loss - piece.loss
        if self.can_cut and self.alive and tokens > 0 and len(sequence) < limits.segments:
            k = int(np.where(np.isinf(needs[:, 0]), -1, needs[:, 0]).argmax())
            length = self.waiting[k].longest(tokens, loss)
            if 0 < length < self.waiting[k].length:
                head, tail = self._take(k).cut(length)
                sequence.append(head)
                self._put_back(k, tail)
        return sequence

    @staticmethod
    def _powers(sequence: list[Piece]) -> Iterator[list[Piece]]:
        """The last sequence as some whose lengths are powers of two and need no padding."""
        left = sum(p.length for p in sequence)
        rest = list(reversed(sequence))
        while left:
            room, part = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                piece = rest.pop()
                if piece.length > room:
                    piece, tail = piece.cut(room)
                    rest.append(tail)
                part.append(piece)
                room -= piece.length
            yield part


def pack(
    examples: DataFrame,
    limits: Limits = Limits(),
    cut: bool = True,
    pool: int = POOL,
    loss_col: str | None = None,
) -> DataFrame:
    """Packs ``examples`` (``id, ids, tokens`` as ``tokens.tokenized`` gives them) into sequences; one row per
    piece: ``id, start, length, ids, doc_tokens, loss, sequence_id, offset``.

    ``loss_col`` holds how many of an example's last tokens bear loss (a null: none); without it all do.
    With ``cut`` an example may be split to fill a sequence, and the last sequence of a task becomes some of
    power-of-two lengths; without, examples stay whole, and one beyond the limits raises an error.

    Each task packs its own rows as they stream by, holding ``pool`` examples: there is no shuffle, no group
    to outgrow a task, and the order of the input (a curriculum, say) is kept to within the pool. A retried
    task repeats itself as long as its input comes in a fixed order, as from files.

    Null or repeated ids are packed like any other; an example without tokens is left out; an empty table
    gives no rows; extra columns are not looked at.
    """
    loss = F.col("tokens") if loss_col is None else F.coalesce(F.col(f"`{loss_col}`").cast("long"), F.lit(0))
    slim = examples.select("id", "ids", "tokens", F.least(loss, "tokens").alias("loss")).filter("tokens > 0")
    return slim.mapInArrow(_packing(limits, cut, pool), PIECES_SCHEMA)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int | None,
    limits: Limits = Limits(),
    id_col: str = "doc_id",
    text_col: str = "text",
    pool: int = POOL,
) -> DataFrame:
    """``pack`` of the whole texts of ``docs``, as ``tokens.tokenized`` turns them into ids, all bearing loss and cut where
    that fills a sequence. A task tokenizes and packs in one Python worker, so no ids go back and forth, and it drops
    the words it knows at its end.

    Null and empty texts are ``end_id`` alone; the rest is as for ``tokenized`` and ``pack``.
    """
    encode, packed = tokens.encoder(tokenizer_path, end_id), _packing(limits, True, pool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def examples() -> Iterator[pa.RecordBatch]:
            for batch in encode(batches):
                key, ids, n = batch.columns
                some = pc.greater(n, 0)
                yield pa.RecordBatch.from_arrays([key, ids, n, n], ["id", "ids", "tokens", "loss"]).filter(some)

        return packed(examples())

    return renamed(docs, id=id_col, text=text_col).mapInArrow(run, PIECES_SCHEMA)


def _packing(limits: Limits, cut: bool, pool: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs a stream of batches ``id, ids, tokens, loss`` into pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, sequence_id = Packer(limits, cut, pool), TaskContext.get().partitionId() << 33
        rows: list[tuple] = []

        def made(sequences: Iterator[list[Piece]]) -> None:
            nonlocal sequence_id
            for sequence in sequences:
                offset = 0
                for p in sequence:
                    rows.append((p.id, p.start, p.length, bytes(p.ids), p.total, p.loss, sequence_id, offset))
                    offset += p.length
                sequence_id += 1

        for batch in batches:
            for k in range(batch.num_rows):
                key, ids, n, bearing = (batch.column(c)[k] for c in range(4))
                view = memoryview(ids.as_py())
                made(packer.add(Piece(key.as_py(), 0, n.as_py(), bearing.as_py(), view, n.as_py())))
                if len(rows) >= 2000:
                    yield _batch(rows)
                    rows = []
        made(packer.finish())
        if rows:
            yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in PIECES_SCHEMA.split(", ")]
    kinds = [pa.binary() if n == "ids" else pa.int64() for n in names]
    arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names)
