"""Near duplicates by SimHash, linked through BK-trees.

Fingerprints within the radius agree in one of a few blocks of bits. Each block value is a shard; a BK-tree
of the shard's fingerprints (children keyed by their Hamming distance to the parent) is searched along
the edges that can lead to a fingerprint within the radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import as_row, of_row, renamed, with_row
from matchloom.llm.components import components
from matchloom.session import materialise

BITS = 64
SEED = 42
TREE_SIZE = 2048  # fingerprints of one tree; a larger shard is split by further blocks of bits
_WORDS = 1 << 16  # shingles hashed at once


def fingerprint(text: str | None, shingle: int) -> int:
    """Bit by bit the majority of the XXH64 hashes of the word shingles, repeats included."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    hash64, counts, n = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64), len(starts)
    for at in range(0, n, _WORDS):
        spans = zip(starts[at : at + _WORDS].tolist(), ends[at : at + _WORDS].tolist(), strict=True)
        h = np.array([hash64(joined[a:b], SEED) for a, b in spans], dtype=">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(
    docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text", **more: str
) -> DataFrame:
    """``id, fp`` of every whole text; ``fp`` is the 64-bit fingerprint as a signed number. A null text
    is an empty one; a text without words has fingerprint zero, one with fewer words than a shingle
    that of all its words. ``more`` are whole-number columns to go along, as ``new=old``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            along = [batch.column(2 + k).cast(pa.int64()) for k in range(len(more))]
            columns = [batch.column(0).cast(pa.int64()), pa.array(made.view(np.int64)), *along]
            yield pa.RecordBatch.from_arrays(columns, ["id", "fp", *more])

    schema = ", ".join(f"{c} long" for c in ["id", "fp", *more])
    return renamed(docs, id=id_col, text=text_col, **more).mapInArrow(run, schema)


class BkTree:
    """Integers under Hamming distance."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int, radius: int) -> list[int]:
        """Inserts ``value``; the positions of earlier values within ``radius`` of it."""
        near, new = [], len(self.values)
        if new:
            stack, children, values = [0], self.children, self.values
            while stack:
                node = stack.pop()
                d = (value ^ values[node]).bit_count()
                if d <= radius:
                    near.append(node)
                if edges := children[node]:
                    stack += [c for e, c in edges.items() if d - radius <= e <= d + radius]
            node = 0
            while True:
                d = (value ^ values[node]).bit_count()
                child = children[node].get(d)
                if child is None:
                    children[node][d] = new
                    break
                node = child
        self.values.append(value)
        self.children.append({})
        return near


def _spanning(shard: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join what the shard's fingerprints within the radius of each other join: at most
    one less than there are fingerprints, however many pairs are near."""
    tree, above, links = BkTree(), list(range(len(shard))), []

    def top(k: int) -> int:
        while above[k] != k:
            above[k] = above[above[k]]
            k = above[k]
        return k

    values = shard.tolist()
    for k, value in enumerate(values):
        for other in tree.add(value & 0xFFFFFFFFFFFFFFFF, radius):
            a, b = top(k), top(other)
            if a != b:
                above[a] = b
                links.append((value, values[other]))
    return links


def _links_in_shards(rows: DataFrame, radius: int) -> DataFrame:
    """``a, b``: links between fingerprints of one shard, for ``rows`` (shard, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_shard, held = None, np.empty(0, dtype=np.int64)
        for batch in batches:
            shards, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(np.diff(shards)) + 1
            links: list[tuple[int, int]] = []
            parts = np.split(fps, edges)
            keys = shards[np.concatenate([[0], edges])] if len(shards) else []
            for key, part in zip(keys, parts, strict=False):
                if key == held_shard:
                    held = np.concatenate([held, part])
                    continue
                if len(held) > 1:
                    links += _spanning(held, radius)
                held_shard, held = key, part
            yield _pairs(links)
        if len(held) > 1:
            yield _pairs(_spanning(held, radius))

    near = rows.repartition("shard").sortWithinPartitions("shard", "fp")
    return near.mapInArrow(run, "a long, b long")


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    found = np.array(links, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])


def _next_masks(mask: int, radius: int) -> list[int]:
    """The masks that fix one more block of bits, of ``radius + 1`` near-equal ones of the free bits."""
    free = [p for p in range(BITS) if not mask >> p & 1]
    blocks = np.array_split(free, radius + 1)
    return [mask | sum(1 << int(p) for p in block) for block in blocks if len(block)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def links(fps: DataFrame, radius: int, tree_size: int = TREE_SIZE) -> DataFrame:
    """``a, b``: links between distinct fingerprints (``fp``), enough to connect all that a chain of
    steps of at most ``radius`` bits connects.

    Of ``radius + 1`` blocks of bits two such fingerprints share one, so each goes to the shards of its
    block values. Shards of at most ``tree_size`` are searched by a tree; a larger one is cut again by
    blocks of its other bits, as often as needed, so no task holds more than a tree and no link is lost.
    Trees travel to their shard's task by the shuffle; there is nothing to broadcast that grows with the data.
    """
    spark = fps.sparkSession
    # A shard is the bits it fixes (the mask) and their values; which masks there are depends on no data.
    masks, found = [0], []
    rows = fps.select(F.lit(0).cast("long").alias("mask"), "fp")
    while True:
        following = {m: _next_masks(m, radius) for m in masks}
        table = [(_signed(m), [_signed(x) for x in more]) for m, more in following.items()]
        step = spark.createDataFrame(table, "mask long, more array<long>")
        keyed = (
            rows.join(F.broadcast(step), "mask")
            .select("fp", F.explode("more").alias("mask"))
            .withColumn("shard", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))
        )
        keyed = materialise(keyed, "shards")
        sizes = materialise(keyed.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1"), "shard-sizes")
        small = keyed.join(sizes.filter(F.col("n") <= tree_size), "shard", "left_semi").select("shard", "fp")
        found.append(_links_in_shards(small, radius))
        hot = sizes.filter(F.col("n") > tree_size)
        if hot.isEmpty():
            break
        rows = materialise(keyed.join(hot, "shard", "left_semi").select("mask", "fp").distinct(), "large-shards")
        used = {r[0] for r in rows.select("mask").distinct().collect()}  # some of the masks named above
        masks = [x for more in following.values() for x in more if _signed(x) in used]
    out = found[0]
    for more_links in found[1:]:
        out = out.unionByName(more_links)
    return out


def _rooted(rows: DataFrame, radius: int, first: Column) -> DataFrame:
    """``fp, first, root`` of every distinct fingerprint of ``rows``, ``first`` aggregated over its rows."""
    classes = materialise(rows.groupBy("fp").agg(first.alias("first")), "classes")
    roots = materialise(components(links(classes.select("fp"), radius)), "roots")
    return classes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )


def near_groups(
    docs: DataFrame, shingle: int, radius: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, fp, component`` of every row: the least id reachable through fingerprints that differ in at
    most ``radius`` bits, equal ones included.

    Copies meet by their fingerprint and are never paired. Null texts are empty, and texts without
    words all share fingerprint zero; a row with a null id takes part and links others, but its id names no
    component unless all ids are null; repeated rows get a row each; an empty table gives no rows; extra
    columns are not looked at.
    """
    rows = materialise(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    rooted = _rooted(rows, radius, F.min("id"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    known = rooted.join(least, "root").select("fp", "component")
    return rows.join(known, "fp").select("id", "fp", "component")


def keep_one(
    docs: DataFrame, shingle: int, radius: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of ``docs`` per component, with all its columns, whatever they are called: the one with the least id,
    null last, of rows alike in id the first by a hash of all columns. Rows are told apart by a key of their own, so ids may
    be null or repeat: each component leaves exactly one row. A null text is an empty one; all texts without words are
    one component. Empty table: no rows."""
    every = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("hash")
    keyed = with_row(docs.select(as_row(docs), every), "key")
    slim = keyed.select(of_row(id_col).alias("id"), of_row(text_col).alias("text"), "hash", "key")
    prints = materialise(fingerprints(slim, shingle, "id", "text", hash="hash", row="key"), "fingerprints")
    rooted = _rooted(prints, radius, F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "hash", "row")))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("key"))
    return keyed.join(kept, "key", "left_semi").select("row.*")
