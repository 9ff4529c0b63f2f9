"""Expressions and helpers the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def whole_text(name: str) -> Column:
    """The text, a null as an empty one."""
    return F.coalesce(F.col(name), F.lit(""))


def word_count(name: str) -> Column:
    return F.regexp_count(whole_text(name), F.lit(WORD)).cast("long")


def renamed(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, as ``new=old``. Extra columns, whatever their names, stay behind."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in names.items()])


def as_row(df: DataFrame) -> Column:
    """All columns of a row as one value, so that whatever they are called none meets a name of the operator's own.
    ``select("row.*")`` gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def of_row(name: str) -> Column:
    return F.col(f"row.`{name}`")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or what comes of adding underscores to it until no column of ``df`` is called that."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a key of each row in ``name``, written once, so that all who read it see the same keys. Whole rows
    with their texts are written, hence compressed harder than is usual."""
    return materialise(df.withColumn(name, F.monotonically_increasing_id()), "rows", "zstd")


def pieces_of(rows: int, each: int) -> int:
    """Partitions of about ``each`` rows; at least one."""
    return max(1, -(-rows // each))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its row number from 0 in the given order, made without a window over all rows.

    The rows are range-sorted and written once, so that their places are fixed; only the number of
    rows of each written partition passes the driver.
    """
    place = F.monotonically_increasing_id()
    rows = materialise(df.sort(*order).withColumn("_place", place), "numbered")
    part = F.shiftright("_place", 33)
    counts = sorted(rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts, before = [], 0
    for p, n in counts:
        starts.append((p, before))
        before += n
    offsets = df.sparkSession.createDataFrame(starts, "_part long, _before long")
    local = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        rows.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + local)
        .drop("_part", "_place", "_before")
    )
