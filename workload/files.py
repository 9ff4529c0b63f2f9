"""Files and tables written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from matchloom.plans.extracts import SALES_NAMES, files_to_table
from matchloom.session import scratch_path
from matchloom.sinks.tables import replace_csv, replace_parquet, replace_table
from matchloom.sources.tabular import read_extract, read_folder
from workload.inputs import table


def csv_header_scan(spark, sf):
    path = scratch_path(spark, "customer-csv")
    replace_csv(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), path)
    return read_extract(spark, path, schema="c_custkey bigint, c_name string, c_mktsegment string")


def csv_sink_roundtrip(spark, sf):
    path = scratch_path(spark, "supplier-csv")
    supplier = table(spark, sf, "supplier").select(
        "s_suppkey",
        F.concat(F.col("s_name"), F.lit(', "quoted"\nline')).alias("s_name"),
        F.when(F.col("s_nationkey") > 20, F.lit("far")).when(F.col("s_nationkey") > 10, F.lit("")).alias("note"),
        "s_nationkey",
    )
    replace_csv(supplier.limit(0), path)
    replace_csv(supplier, path)
    schema = "s_suppkey bigint, s_name string, note string, s_nationkey int"
    return read_extract(spark, path, schema=schema, multi_line=True)


def parquet_overwrite(spark, sf):
    path = scratch_path(spark, "orders")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    replace_parquet(orders, path)
    replace_parquet(
        orders.filter(F.col("o_orderstatus") != "F"), path, partition_by=("o_orderpriority",)
    )
    return spark.read.schema(orders.schema).parquet(path)


def table_replace(spark, sf):
    name, path = f"customer_{uuid.uuid4().hex}", scratch_path(spark, "table")
    customer = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    replace_table(customer, name, path)
    replace_table(customer.filter(F.col("c_acctbal") > 0).drop("c_acctbal"), name, path)
    return spark.table(name)


def multi_file_union(spark, sf):
    """One folder of files that lack a column or have them in another order."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    path, status = scratch_path(spark, "orders"), F.col("o_orderstatus")
    replace_csv(orders.filter(status == "F").drop("o_orderpriority"), f"{path}/done")
    replace_csv(orders.filter(status == "O"), f"{path}/open")
    turned = orders.select("o_orderpriority", "o_orderstatus", "o_orderkey", "o_custkey")
    replace_csv(turned.filter((status != "F") & (status != "O")), f"{path}/other")
    return read_folder(spark, path, {"o_orderkey": "bigint", "o_custkey": "bigint"})


def sales_to_table(spark, sf):
    """Line items as two sales extracts, one without the quantity and with brands that are no
    numbers, into a table whose columns are all text."""
    sales = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("ID_MARCA"),
        F.concat(F.lit("marca "), F.col("l_suppkey").cast("string")).alias("MARCA"),
        F.col("l_partkey").alias("ID_LINHA"),
        F.concat(F.lit("linha "), F.col("l_partkey").cast("string")).alias("LINHA"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("DATA_VENDA"),
        F.col("l_quantity").cast("int").alias("QTD_VENDA"),
        "l_returnflag",
    )
    returned, kept = scratch_path(spark, "sales-returned"), scratch_path(spark, "sales-kept")
    lettered = sales.withColumn("ID_MARCA", F.concat(F.lit("A"), F.col("ID_MARCA").cast("string")))
    replace_csv(lettered.filter(F.col("l_returnflag") == "R").drop("QTD_VENDA"), returned)
    replace_csv(sales.filter(F.col("l_returnflag") != "R").drop("l_returnflag"), kept)
    name = f"sales_{uuid.uuid4().hex}"
    files_to_table(
        spark, [returned, kept], name, "csv", SALES_NAMES, table_path=scratch_path(spark, "sales")
    )
    return spark.table(name)


QUERIES = {
    "csv_header_scan": csv_header_scan,
    "csv_sink_roundtrip": csv_sink_roundtrip,
    "parquet_overwrite": parquet_overwrite,
    "table_replace": table_replace,
    "multi_file_union": multi_file_union,
    "files_to_table": sales_to_table,
}

ORACLE = {
    "csv_header_scan": "SELECT c_custkey, c_name, c_mktsegment FROM customer",
    "csv_sink_roundtrip": """
        SELECT s_suppkey, s_name || ', "quoted"' || chr(10) || 'line' AS s_name,
               CASE WHEN s_nationkey > 20 THEN 'far' WHEN s_nationkey > 10 THEN '' END AS note, s_nationkey
        FROM supplier""",
    "parquet_overwrite": "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus <> 'F'",
    "table_replace": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0",
    "multi_file_union": """
        SELECT o_orderkey, o_custkey, o_orderstatus,
               CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS o_orderpriority
        FROM orders""",
    "files_to_table": """
        SELECT CASE WHEN l_returnflag = 'R' THEN 'A' ELSE '' END || l_suppkey AS marca_id,
               'marca ' || l_suppkey AS marca_name, l_partkey::VARCHAR AS linha_id,
               'linha ' || l_partkey AS linha_name, l_orderkey || '-' || l_linenumber AS venda_date,
               CASE WHEN l_returnflag <> 'R' THEN l_quantity::INT::VARCHAR END AS venda_quantity,
               CASE WHEN l_returnflag = 'R' THEN l_returnflag END AS l_returnflag
        FROM lineitem""",
}
