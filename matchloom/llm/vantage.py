"""Clusters of integer vectors around centroids that a vantage-point tree finds.

The few centroids are put in a tree that is built anew each round and travels to all tasks. A vector follows the tree
best first: of the nodes it has not looked at, the one that may hold the nearest centroid, until none can hold one
that is as near as the best found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import renamed
from matchloom.session import materialise

CLUSTERS, ROUNDS, WIDTH, SCALE = 16, 3, 64, 64
LARGEST = 1 << 26  # above it a squared distance of WIDTH components may not fit 64 bits
_SLACK = 1e-9  # more than what a square root of an exact distance can be off


@dataclass(frozen=True)
class Tree:
    """Node k holds centroid ``numbers[k]``. ``children[k]`` are up to two nodes with the least and greatest distance of
    all centroids below each to node k's own."""

    points: np.ndarray
    numbers: list[int]
    children: list[list[tuple[int, float, float]]]


def build(centroids: np.ndarray) -> Tree:
    numbers: list[int] = []
    children: list[list[tuple[int, float, float]]] = []

    def grow(members: list[int]) -> int:
        node, own = len(numbers), members[0]
        numbers.append(own)
        children.append([])
        rest = members[1:]
        if rest:
            away = {m: float(np.sqrt(((centroids[m] - centroids[own]) ** 2).sum())) for m in rest}
            ranked = sorted(rest, key=lambda m: (away[m], m))
            half = (len(ranked) + 1) // 2
            for part in (ranked[:half], ranked[half:]):
                if part:
                    near, far = away[part[0]], away[part[-1]]
                    children[node].append((grow(part), near, far))
        return node

    if len(centroids):
        grow(list(range(len(centroids))))
    return Tree(centroids[numbers] if numbers else centroids, numbers, children)


def nearest(tree: Tree, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each vector (of equally near ones the smallest) and the squared distance.

    Every vector goes its own way through the tree; vectors that look at one node at a time are handled together.
    ``bound`` holds, for each vector and node still to be looked at, what a centroid below the node is away at
    least. A node is looked at as long as that is at most the best distance found, itself included, so that a
    centroid as near as the best, with a smaller number, is found too. Distances are compared as integers.
    """
    n = len(vectors)
    best = np.full(n, np.iinfo(np.int64).max)
    number = np.full(n, len(tree.numbers), dtype=np.int64)
    radius = np.full(n, np.inf)
    bound = np.full((n, len(tree.numbers)), np.inf)
    bound[:, :1] = 0.0
    rows = np.arange(n)
    while len(rows):
        node = bound[rows].argmin(axis=1)
        least = bound[rows, node]
        go = (least < np.inf) & (least <= radius[rows] * (1 + _SLACK) + _SLACK)
        rows, node, least = rows[go], node[go], least[go]
        for k in np.unique(node):
            here = rows[node == k]
            bound[here, k] = np.inf
            away = ((vectors[here] - tree.points[k]) ** 2).sum(axis=1)
            own = tree.numbers[k]
            better = (away < best[here]) | ((away == best[here]) & (own < number[here]))
            best[here[better]], number[here[better]] = away[better], own
            root = np.sqrt(away)
            radius[here] = np.sqrt(best[here])
            for child, near, far in tree.children[k]:
                bound[here, child] = np.maximum.reduce([least[node == k], near - root, root - far])
    return number, best


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _sums(rows: DataFrame, tree: Tree, width: int) -> dict[int, tuple[int, list[int]]]:
    """Number and componentwise sums of the vectors of each centroid that has any; only these, at most
    centroids times components, reach the driver."""
    clusters = len(tree.numbers)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(clusters, dtype=np.int64), np.zeros((clusters, width), dtype=np.int64)
        for batch in batches:
            vectors = _vectors(batch.column(0))
            number, _ = nearest(tree, vectors)
            counts += np.bincount(number, minlength=clusters)
            np.add.at(sums, number, vectors)
        held = np.flatnonzero(counts)
        columns = [
            np.repeat(held, width).astype(np.int32), np.tile(np.arange(width, dtype=np.int32), len(held)),
            np.repeat(counts[held], width), sums[held].reshape(-1),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cluster", "place", "n", "total"])

    parts = rows.select("vector").mapInArrow(add, "cluster int, place int, n long, total long")
    summed = parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in summed.collect():
        out.setdefault(r["cluster"], (r["n"], [0] * width))[1][r["place"]] = r["total"]
    return out


def _assigned(rows: DataFrame, tree: Tree) -> DataFrame:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, away = nearest(tree, _vectors(batch.column(1)))
            columns = [batch.column(0), pa.array(number.astype(np.int32)), pa.array(away)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "cluster", "distance"])

    return rows.mapInArrow(assign, "id long, cluster int, distance long")


def integer_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH, scale: int = SCALE
) -> DataFrame:
    """``id, vector``: the rows whose vector has ``width`` components, none null or not finite, each turned into
    ``floor(scale * x)``."""
    x = F.transform("vector", lambda v: v.cast("double"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    given = renamed(vectors, id=id_col, vector=vector_col)
    kept = given.withColumn("vector", x).filter((F.size("vector") == width) & finite)
    whole = F.transform("vector", lambda v: F.floor(v * scale))
    return kept.select(F.col("id").cast("long").alias("id"), whole.alias("vector"))


def seed_order(id_: Column) -> Column:
    return F.sha2(F.concat(F.lit("1:"), id_.cast("string")), 256)


def clusters(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    count: int = CLUSTERS,
    rounds: int = ROUNDS,
    width: int = WIDTH,
    scale: int = SCALE,
) -> DataFrame:
    """``id, cluster, distance, cluster_inertia, inertia, centroid`` of every vector that ``integer_vectors`` keeps.

    The first centroids are the ``count`` vectors that come first by the SHA-256 of their id. Each round puts
    every vector to its nearest centroid (of equally near ones that with the smaller number) and moves centroids that
    have vectors to the floor of their mean; the last assignment follows. Distances and sums are whole numbers, so
    the result does not depend on how the rows are split. ``centroid`` is the last centroid's components.

    The vectors are written once as whole numbers and read by each round; a round sends its tree of ``count``
    centroids to the tasks and gets ``count`` times ``width`` sums back, whatever the number of vectors.

    Nulls: a vector that is null, of another length or has a null or non-finite component gives no row; a null
    id is assigned, but is a first centroid only if there are too few other ids. Repeated rows and ids are vectors
    of their own. With fewer vectors than ``count`` there are fewer centroids. Empty table: no rows. A component
    beyond ``LARGEST`` after scaling raises an error, as distances would not fit 64 bits. Other columns are not
    looked at.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, id_col, vector_col, width, scale)
    large = F.exists("vector", lambda v: F.abs(v) > LARGEST)
    told = F.when(large, F.raise_error(F.lit("a component is too large for whole distances of 64 bits")).cast("boolean"))
    rows = materialise(rows.filter(F.coalesce(told, F.lit(True))), "vectors")
    first = rows.orderBy(seed_order(F.col("id")).asc_nulls_last(), "vector").limit(count).collect()
    centroids = np.array([r["vector"] for r in first], dtype=np.int64).reshape(len(first), width)
    for _ in range(rounds if len(first) else 0):
        for cluster, (n, total) in _sums(rows, build(centroids), width).items():
            centroids[cluster] = [t // n for t in total]
    assigned = materialise(_assigned(rows, build(centroids)), "assigned")
    sums = {r["cluster"]: r["inertia"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    table = [(k, sums[k], sum(sums.values()), centroids[k].tolist()) for k in sorted(sums)]
    about = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return assigned.join(F.broadcast(about), "cluster").select(
        "id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"
    )
