"""Column-wise cleaning: narrow operators, no shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.functions.draws import hash_id
from matchloom.functions.text import join_text


def trim_all(df: DataFrame) -> DataFrame:
    """Trim every string column; a blank becomes an empty string, never null."""
    return df.select(
        *[
            F.trim(f.name).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def filter_code(df: DataFrame, column: str, code: str, width: int | None = None) -> DataFrame:
    """Rows whose trimmed column equals the code.

    Where the code fills the whole field (``width``), trimming cannot change the
    outcome, so the plain column is compared and the test reaches the file scan.
    """
    if width is not None and len(code) == width and code == code.strip(" "):
        return df.filter(F.col(column) == code)
    return df.filter(F.trim(column) == code)


def numbered(stems: Sequence[str], last: int) -> list[str]:
    """Column names ``<stem>_<i>``, by number and then by stem."""
    return [f"{stem}_{i}" for i in range(1, last + 1) for stem in stems]


def concat_columns(df: DataFrame, columns: Sequence[str], into: str) -> DataFrame:
    """Join columns into one cleaned text and drop them."""
    return df.withColumn(into, join_text(*[F.col(c) for c in columns])).drop(*columns)


def suffix_columns(df: DataFrame, columns: Sequence[str], suffix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}_{suffix}" for c in columns})


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename by map; names the frame lacks are ignored."""
    return df.withColumnsRenamed(dict(names))


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Without the named columns; names the frame lacks are ignored."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in set(columns)])


def keep_members(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose column is among the ids (a frame of one column), however often it is there.
    A null is no member."""
    (member,) = ids.columns
    return df.join(ids.select(F.col(member).alias(column)), column, "left_semi").select(*df.columns)


def with_id(df: DataFrame, name: str = "id", keys: Sequence[str] | None = None) -> DataFrame:
    """Add an id. With ``keys`` it is a hash of them (text), the same in every layout;
    without, a number that is unique but depends on how the input is split."""
    if keys:
        return df.withColumn(name, hash_id(*[F.col(k) for k in keys]))
    return df.withColumn(name, F.monotonically_increasing_id())


def with_extraction_time(df: DataFrame, name: str = "extracted_at") -> DataFrame:
    return df.withColumn(name, F.current_timestamp())
