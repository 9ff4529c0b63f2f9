"""Delimited extracts with a header, alone or many together."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("csv", "parquet", "json", "orc")
# How delimited files are written and read here: quotes in a text are doubled, an empty text is written as
# two quotes and a null as nothing. The null mark stands in no file; it only keeps the two apart on reading.
CSV_WRITE = {"header": "true", "quote": '"', "escape": '"', "nullValue": "", "emptyValue": '""'}
CSV_READ = {"header": "true", "quote": '"', "escape": '"', "nullValue": "\x00", "emptyValue": "", "enforceSchema": "false"}


def read_extract(
    spark: SparkSession,
    path: str | Sequence[str],
    fmt: str = "csv",
    schema: str | T.StructType | None = None,
    infer: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """Read one extract, or files with the same columns in the same order; anything else is an error.

    The columns of a CSV file are text unless a ``schema`` says otherwise, so types do not depend on the
    rows a file happens to hold; ``infer`` asks for types found in the data, at the cost of a pass
    over it. ``multi_line`` is for texts that hold line ends; such files are not split.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt!r} is not one of {FORMATS}")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.options(**CSV_READ).option("multiLine", multi_line)
        reader = reader.option("inferSchema", infer and schema is None)
    return reader.format(fmt).load(path if isinstance(path, str) else list(path))


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames by column name; a column a frame lacks is null there."""
    if not frames:
        raise ValueError("no extract to union")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """``header, files``: the distinct first lines of the files of a folder or glob, and the files that begin with each.
    One job reads them all; a file without a line is in none."""
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .text(path)
        .select(
            "value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place")
        )
        .filter(F.col("_metadata.file_block_start") == 0)
    )
    firsts = lines.groupBy("file").agg(F.min_by("value", "place").alias("header"))
    return firsts.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files"))


def read_folder(
    spark: SparkSession, path: str, types: Mapping[str, str] | None = None, multi_line: bool = False
) -> DataFrame:
    """Unite the CSV files of a folder, whose columns may differ in number and order, by column name.

    Files are grouped by their header, which one job finds for all of them, and every group is read as one
    frame. Columns are text, or of the type that ``types`` names; the driver holds the file names, as it does
    wherever Spark reads files.
    """
    types = types or {}
    frames = []
    for line, found in sorted(map(tuple, headers(spark, path).collect())):
        files = [unquote(f) for f in found]  # the column holds URIs
        if multi_line and line.count('"') % 2:  # the header goes on in the next line
            columns = spark.read.options(**CSV_READ).option("multiLine", True).csv(files[0]).columns
        else:
            columns = [name or f"_c{k}" for k, name in enumerate(next(csv.reader([line.lstrip("\ufeff")])))]
        schema = ", ".join(f"`{c}` {types.get(c, 'string')}" for c in columns)
        frames.append(read_extract(spark, files, "csv", schema, multi_line=multi_line))
    return union_by_name(frames)


def read_extracts(
    spark: SparkSession,
    paths: Sequence[str],
    fmt: str = "csv",
    schemas: Mapping[str, str] | None = None,
) -> DataFrame:
    """Read several extracts of one kind, whose columns may differ, as one frame. Files of a CSV folder
    without a schema may differ too; a path with one holds files of those columns."""
    schemas = schemas or {}
    return union_by_name(
        [
            read_folder(spark, p) if fmt == "csv" and p not in schemas else read_extract(spark, p, fmt, schemas.get(p))
            for p in paths
        ]
    )
