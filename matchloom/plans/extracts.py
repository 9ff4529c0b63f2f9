"""Extracts job: files of one kind, united and renamed, replace a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from matchloom.operators.projection import rename_columns
from matchloom.sinks.tables import replace_jdbc, replace_table
from matchloom.sources.tabular import read_extracts

# Column names of the sales extracts: fixed values.
SALES_NAMES = {
    "ID_MARCA": "marca_id",
    "MARCA": "marca_name",
    "ID_LINHA": "linha_id",
    "LINHA": "linha_name",
    "DATA_VENDA": "venda_date",
    "QTD_VENDA": "venda_quantity",
}


def unite_extracts(
    spark: SparkSession,
    paths: Sequence[str],
    fmt: str = "csv",
    names: Mapping[str, str] | None = None,
    schemas: Mapping[str, str] | None = None,
) -> DataFrame:
    return rename_columns(read_extracts(spark, paths, fmt, schemas), names or {})


def files_to_table(
    spark: SparkSession,
    paths: Sequence[str],
    table: str,
    fmt: str = "csv",
    names: Mapping[str, str] | None = None,
    schemas: Mapping[str, str] | None = None,
    table_path: str | None = None,
    jdbc_url: str | None = None,
    jdbc_properties: dict[str, str] | None = None,
) -> None:
    """Replace a catalog table, or a table of a SQL database if a URL is given."""
    df = unite_extracts(spark, paths, fmt, names, schemas)
    if jdbc_url is not None:
        replace_jdbc(df, jdbc_url, table, properties=jdbc_properties)
    else:
        replace_table(df, table, table_path)
