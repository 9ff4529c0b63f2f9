"""Equi-join that stays even when a few keys hold much of either side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.session import materialise

_SPREAD = 4  # a spreading join yields much from little: small inputs even out its tasks
CELL_ROWS = 10_000  # rows of one side of a hot key that one task joins
_COPIES = 64  # tasks that tell the rows of one hot key into how many parts it is split


_KEY = "_key"


def _key(columns: Sequence[str]) -> Column:
    # Hot keys are told by their hash, so that the list of them is small however
    # long the keys are. Keys that share a hash are merely split alike.
    return F.xxhash64(*[F.col(c) for c in columns]).alias(_KEY)


def key_counts(df: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """``_key, n``: rows per (hash of a) key, or the sum of a column that says how
    many rows each one stands for. Summed before the shuffle."""
    n = F.count("*") if weight is None else F.sum(weight)
    return df.groupBy(_key(keys)).agg(n.alias("n"))


def hot_keys(counts: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``_key, parts``: the keys of a ``key_counts`` frame with more than ``cell_rows`` rows and into how many parts
    of about ``cell_rows`` rows each is to be split."""
    return counts.filter(F.col("n") > cell_rows).select(_KEY, F.ceil(F.col("n") / cell_rows).cast("int").alias("parts"))


def grid_places(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_row: Sequence[str],
    right_row: Sequence[str],
    left_counts: DataFrame | None = None,
    right_counts: DataFrame | None = None,
    cell_rows: int = CELL_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Both sides with the cell ``_gl, _gr`` of their key's grid that each row belongs to, copied along the other side.

    The keys with more than ``cell_rows`` rows on a side, however many they are, are counted, written and joined to the
    rows of both sides by a shuffle. In it each such key is there once for each of some tasks, and its rows go to
    all of these, so that telling the rows of a key their parts is spread as well.
    """
    on = list(on)
    lc = left_counts if left_counts is not None else key_counts(left, on)
    rc = right_counts if right_counts is not None else key_counts(right, on)
    hot = (
        hot_keys(lc, cell_rows)
        .withColumnRenamed("parts", "_lp")
        .join(hot_keys(rc, cell_rows).withColumnRenamed("parts", "_rp"), _KEY, "full_outer")
        .select(
            _KEY,
            F.coalesce("_lp", F.lit(1)).alias("_lp"),
            F.coalesce("_rp", F.lit(1)).alias("_rp"),
        )
    )
    hot = materialise(hot, "hot-keys")
    most = hot.agg(F.max(F.greatest("_lp", "_rp"))).first()[0]
    if most is None:
        none = {"_gl": F.lit(0), "_gr": F.lit(0)}
        return left.withColumns(none), right.withColumns(none)
    copies = min(_COPIES, most)
    parts = hot.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

    def place(side: DataFrame, row: Sequence[str], own: str, other: str, out: tuple[str, str]) -> DataFrame:
        own_hash = F.xxhash64(*[F.col(c) for c in row])
        spread = F.pmod(own_hash, F.coalesce(own, F.lit(1)))
        along = F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)
        return (
            side.withColumn(_KEY, _key(on))
            .withColumn("_copy", F.pmod(F.shiftright(own_hash, 32), F.lit(copies)).cast("int"))
            .join(parts, [_KEY, "_copy"], "left")
            .withColumn(out[0], spread.cast("int"))
            .withColumn(out[1], F.explode(along))
            .drop(_KEY, "_copy", "_lp", "_rp")
        )

    return place(left, left_row, "_lp", "_rp", ("_gl", "_gr")), place(right, right_row, "_rp", "_lp", ("_gr", "_gl"))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_row: Sequence[str],
    right_row: Sequence[str],
    left_counts: DataFrame | None = None,
    right_counts: DataFrame | None = None,
    cell_rows: int = CELL_ROWS,
    spread: bool = False,
) -> DataFrame:
    """Inner equi-join of ``left`` and ``right`` on the columns ``on``.

    Every key with more than ``cell_rows`` rows on a side is laid out as a grid: its left rows are spread
    over the grid's rows, its right rows over its columns, and each side is copied
    along the other, so that every pair of rows meets in exactly one cell and no
    task holds more than about ``cell_rows`` rows of a side of one key. Other keys are joined
    as they are. ``left_row`` and ``right_row`` name columns whose hash spreads
    the rows of a key, so that a retried task puts them in the same place. Counts
    already known can be passed in to spare the pass for them. ``spread`` is for
    joins that yield far more rows than they read: it uses all shuffle partitions,
    where adaptive execution would merge them by the small size of the input.
    """
    on = list(on)
    a, b = grid_places(left, right, on, left_row, right_row, left_counts, right_counts, cell_rows)
    return _joined(a, b, [*on, "_gl", "_gr"], spread).drop("_gl", "_gr")


def _joined(a: DataFrame, b: DataFrame, on: list[str], spread: bool) -> DataFrame:
    if spread:
        parts = _SPREAD * int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        a, b = a.repartition(parts, *on), b.repartition(parts, *on)
    return a.join(b, on)
