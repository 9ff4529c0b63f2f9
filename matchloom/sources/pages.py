"""Landed JSON result pages of a paged service."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


_ERROR = T.StructField("error", T.StructType([T.StructField("status", T.LongType()), *_strings("message")]))

# Page formats of the service: fixed values.
SHOW_ITEM = T.StructType(
    [*_strings("id", "name", "description"), T.StructField("total_episodes", T.LongType())]
)
EPISODE_ITEM = T.StructType(
    [
        *_strings("id", "description"),
        T.StructField("duration_ms", T.LongType()),
        *_strings("release_date"),
    ]
)
BROKEN = "_broken"  # the text of a document that is no whole JSON object
_BROKEN = T.StructField(BROKEN, T.StringType())
SHOW_PAGE = T.StructType(
    [
        _BROKEN,
        _ERROR,
        T.StructField("shows", T.StructType([T.StructField("items", T.ArrayType(SHOW_ITEM))])),
    ]
)
EPISODE_PAGE = T.StructType(
    [
        _BROKEN,
        _ERROR,
        T.StructField("feed", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("total", T.LongType()),
        T.StructField("items", T.ArrayType(EPISODE_ITEM)),
    ]
)


def read_pages(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a folder of pages, one JSON document per line, with a given schema.
    A key missing in a page is null; no inference pass is run. A document that was cut off or is no
    JSON at all keeps its text in the column ``BROKEN``, and what could be read of it is not used."""
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", BROKEN).json(path)
