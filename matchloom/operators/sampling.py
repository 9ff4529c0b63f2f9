"""Samples of a share or of an exact number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.draws import HEX_DIGITS, hash_below, hash_hex

_STEP = 4  # hex digits looked at per round: at most 65,536 buckets

EVERY = "g"  # above all hashes


def sample_hash(df: DataFrame, key: str, fraction: float, seed: str) -> DataFrame:
    """Bernoulli sample by the hash of the key; narrow, the same in every layout."""
    return df.filter(hash_below(seed, F.col(key), fraction))


def sample_rows(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Spark's own Bernoulli sample; which rows it keeps depends on the layout."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def kth_smallest_hash(hashes: DataFrame, k: int, column: str = "h") -> str:
    """An edge up to which exactly ``k`` hashes of the frame lie (more only if the k-th is there several times); ``EVERY`` if
    it has fewer.

    No row is gathered or sorted for it. A round counts rows by the next digits (a partial
    aggregate to at most 65,536 counts) and finds the bucket holding the k-th; if that is not its last one, the
    next round looks into this bucket only. The hashes spread evenly, so a round leaves one row of 65,536: one
    round is enough for some ten thousand rows, two for some billions.
    """
    prefix, left = "", k
    while len(prefix) < HEX_DIGITS:
        inside = hashes.filter(F.col(column).startswith(prefix)) if prefix else hashes
        upto = len(prefix) + _STEP
        counts = inside.groupBy(F.substring(column, 1, upto).alias("bucket")).agg(
            F.count("*").alias("n")
        )
        running = counts.withColumn("seen", F.sum("n").over(Window.orderBy("bucket")))
        cut = running.filter(F.col("seen") >= left).orderBy("bucket").first()
        if cut is None:
            return EVERY
        prefix, left = cut["bucket"], left - (cut["seen"] - cut["n"])
        if left == cut["n"]:
            break
    return prefix.ljust(HEX_DIGITS, "f")


def draw_edge(df: DataFrame, key: str, k: int, seed: str, rows: Column | None = None) -> str | None:
    """Hash up to which the keys belong to a draw of exactly ``k`` of the
    (optionally filtered) rows; None for an empty draw."""
    if k <= 0:
        return None
    if rows is not None:
        df = df.filter(rows)
    return kth_smallest_hash(df.select(hash_hex(seed, F.col(key)).alias("h")), k)


def drawn(key: str, seed: str, edge: str | None) -> Column:
    """True for the keys of the draw: a test of the row alone, no join needed."""
    if edge is None:
        return F.lit(False)
    return hash_hex(seed, F.col(key)) <= F.lit(edge)


def sample_exact(df: DataFrame, key: str, k: int, seed: str, strict: bool = False) -> DataFrame:
    """Exactly ``k`` rows without replacement, drawn by the hash of a unique key.

    With fewer than ``k`` rows all are kept, or ``strict`` raises. The edge of the
    draw is found when the operator is called; the sample itself is a plain filter.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    edge = draw_edge(df, key, k, seed)
    if strict and edge == EVERY:
        raise ValueError(f"fewer than {k} rows to draw from")
    return df.filter(drawn(key, seed, edge))


def limit_by_hash(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """At most ``n`` rows. Unlike ``limit`` it moves no rows to one task and
    always keeps the same ones."""
    return sample_exact(df, key, n, seed)


def not_in_draw(df: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the chosen ones."""
    return df.join(chosen.select(key), key, "left_anti")
