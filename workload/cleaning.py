"""Reading, projecting, filtering and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.functions.text import any_longer_than, any_not_null, collapse_spaces
from matchloom.operators.counts import stage_counts
from matchloom.operators.layout import Field, parse_fixed_width
from matchloom.operators.projection import drop_columns as without_columns
from matchloom.operators.projection import (
    concat_columns,
    filter_code,
    keep_members,
    numbered,
    rename_columns,
    suffix_columns,
    trim_all,
    with_extraction_time,
    with_id,
)
from matchloom.sources.lines import read_lines, read_numbered_lines
from workload.inputs import pad, table, write_lines

CUSTOMER_LAYOUT = (
    Field("row_code", 0, 12),
    Field("nation_code", 0, 2),
    Field("customer_key", 3, 10),
    Field("customer_name", 13, 25),
    Field("segment", 39, 12),
    Field("beyond", 60, 5),
)


def _customer_lines(customer):
    return customer.select(
        F.concat(
            F.lpad(F.col("c_nationkey").cast("string"), 2, "0"),
            F.lpad(F.col("c_custkey").cast("string"), 10, "0"),
            pad(F.col("c_name"), 25),
            F.lit("#"),
            pad(F.col("c_mktsegment"), 12),
        ).alias("value")
    )


def line_scan(spark, sf):
    lines = _customer_lines(table(spark, sf, "customer"))
    with_blanks = lines.select(F.explode(F.array(F.col("value"), F.lit(""), F.lit("  \t"))).alias("value"))
    return read_lines(spark, write_lines(with_blanks, "lines"))


def line_scan_csv_compat(spark, sf):
    c = table(spark, sf, "customer")
    quoted = F.concat(F.lit('"'), F.col("c_name"), F.lit(","), F.col("c_mktsegment"), F.lit('",x'))
    plain = F.concat_ws(",", "c_name", "c_mktsegment")
    lines = c.select(F.when(F.col("c_nationkey") < 10, quoted).otherwise(plain).alias("value"))
    return read_lines(spark, write_lines(lines, "csv-lines"), csv_compat=True)


def fixed_width_parse(spark, sf):
    return parse_fixed_width(_customer_lines(table(spark, sf, "customer")), CUSTOMER_LAYOUT)


def trim_every_column(spark, sf):
    padded = table(spark, sf, "supplier").select(
        "s_suppkey",
        F.concat(F.lit("  "), F.col("s_name"), F.lit(" \t ")).alias("s_name"),
        F.when(F.col("s_nationkey") < 5, F.lit("   ")).otherwise(F.lit(" x  y ")).alias("note"),
    )
    return trim_all(padded)


def select_generated_columns(spark, sf):
    renamed = table(spark, sf, "lineitem").withColumnsRenamed(
        {"l_quantity": "amount_1", "l_discount": "rate_1", "l_extendedprice": "amount_2", "l_tax": "rate_2"}
    )
    return renamed.select("l_orderkey", "l_linenumber", *numbered(["amount", "rate"], 2))


def drop_columns(spark, sf):
    return without_columns(table(spark, sf, "orders"), ["o_orderdate", "o_totalprice", "no_such_column"])


def suffix_rename(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    return suffix_columns(part, ["p_partkey", "p_name"], "a")


def map_rename(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return rename_columns(orders, {"o_orderkey": "venda_id", "o_custkey": "marca_id", "absent": "x"})


def filter_by_code(spark, sf):
    customer = table(spark, sf, "customer").select("c_custkey", pad(F.col("c_mktsegment"), 12).alias("segment"))
    return filter_code(customer, "segment", "BUILDING")


def word_count_filter(spark, sf):
    docs = table(spark, sf, "documents")
    # Besides the whole table, rows with a null on either side.
    texts = docs.select("doc_id", "text", F.regexp_replace("source", "1", " ").alias("source"))
    nulls = docs.select(
        (-F.col("doc_id") - 1).alias("doc_id"),
        F.when(F.col("lang") == "en", F.substring("text", 1, 12)).alias("text"),
        F.when(F.col("lang") != "de", F.regexp_replace("source", "1", " ")).alias("source"),
    )
    every = texts.unionByName(nulls)
    return every.filter(any_longer_than([F.col("text"), F.col("source")], 2)).select("doc_id")


def either_not_null(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        F.expr("nullif(o_orderstatus, 'F')").alias("status"),
        F.expr("nullif(o_orderpriority, '5-LOW')").alias("priority"),
    )
    return orders.filter(any_not_null([F.col("status"), F.col("priority")]))


def id_membership(spark, sf):
    ids = table(spark, sf, "customer").filter(F.col("c_mktsegment") == "BUILDING")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return keep_members(orders, "o_custkey", ids.select("c_custkey"))


def complement_concat(spark, sf):
    part = table(spark, sf, "part").select(
        "p_partkey",
        F.expr("nullif(p_brand, 'Brand#3')").alias("complemento_elemento_1"),
        F.when(F.col("p_size") > 20, F.lit("")).otherwise(F.lit("  lote")).alias("complemento_valor_1"),
        F.lit("").alias("complemento_elemento_2"),
        F.concat(F.col("p_type"), F.lit("\t \t")).alias("complemento_valor_2"),
        F.lit("").alias("complemento_elemento_3"),
        F.col("p_name").alias("complemento_valor_3"),
    )
    parts = numbered(["complemento_elemento", "complemento_valor"], 3)
    return concat_columns(part, parts, "complemento_concatenado")


def collapse_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", collapse_spaces(F.col("text")).alias("text"))


def surrogate_id_hash(spark, sf):
    return with_id(table(spark, sf, "orders").select("o_orderkey"), "id", ["o_orderkey"])


def surrogate_id_two_keys(spark, sf):
    """Ids of two keys that hold colons and nulls and, joined, would read alike."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 3 == 0, F.lit("a:b")).when(F.col("o_orderkey") % 3 == 1, "a").alias("x"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit("c")).when(F.col("o_orderkey") % 5 == 0, "b:c").alias("y"),
    )
    return with_id(orders, "id", ["x", "y"])


def surrogate_id_monotonic(spark, sf):
    ids = with_id(table(spark, sf, "orders").select("o_orderpriority"))
    return ids.groupBy("o_orderpriority").agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("id").alias("n_ids"),
        (F.min("id") >= 0).alias("no_negative_id"),
    )


def surrogate_id_position(spark, sf):
    """Customers written as lines in several files, some of them empty lines, and told apart by where they stand."""
    customer = table(spark, sf, "customer").orderBy("c_custkey")
    blank = F.when(F.col("c_custkey") % 7 == 0, F.lit("")).otherwise(F.concat_ws("|", "c_custkey", "c_name"))
    return read_numbered_lines(spark, write_lines(customer.select(blank.alias("value")), "customers"))


def extracted_at(spark, sf):
    """What can be said of a clock: one instant, for every row."""
    stamped = with_extraction_time(table(spark, sf, "customer").select("c_custkey"))
    return stamped.agg(
        F.count("extracted_at").alias("n_stamped"),
        F.countDistinct("extracted_at").alias("n_instants"),
        (F.min("extracted_at") > F.lit("2024-01-01").cast("timestamp")).alias("plausible"),
    )


def stage_row_counts(spark, sf):
    part, orders = table(spark, sf, "part"), table(spark, sf, "orders")
    return stage_counts(
        {
            "filter": (part, part.filter(F.col("p_size") > 40)),
            "membership": (orders, id_membership(spark, sf)),
            "names": (part, part.select("p_name").distinct()),
        }
    )


QUERIES = {
    "line_scan": line_scan,
    "line_scan_csv_compat": line_scan_csv_compat,
    "fixed_width_parse": fixed_width_parse,
    "trim_all": trim_every_column,
    "select_generated_columns": select_generated_columns,
    "drop_columns": drop_columns,
    "suffix_rename": suffix_rename,
    "map_rename": map_rename,
    "filter_code": filter_by_code,
    "word_count_filter": word_count_filter,
    "either_not_null": either_not_null,
    "id_membership": id_membership,
    "complement_concat": complement_concat,
    "collapse_spaces": collapse_text,
    "surrogate_id_hash": surrogate_id_hash,
    "surrogate_id_two_keys": surrogate_id_two_keys,
    "surrogate_id_monotonic": surrogate_id_monotonic,
    "surrogate_id_position": surrogate_id_position,
    "extracted_at": extracted_at,
    "stage_row_counts": stage_row_counts,
}

ORACLE = {
    "line_scan": """
        SELECT lpad(c_nationkey::VARCHAR, 2, '0') || lpad(c_custkey::VARCHAR, 10, '0')
               || rpad(c_name, 25, ' ') || '#' || rpad(c_mktsegment, 12, ' ') AS value
        FROM customer""",
    "line_scan_csv_compat": """
        SELECT CASE WHEN c_nationkey < 10 THEN c_name || ',' || c_mktsegment ELSE c_name END AS value
        FROM customer""",
    "fixed_width_parse": """
        SELECT lpad(c_nationkey::VARCHAR, 2, '0') || lpad(c_custkey::VARCHAR, 10, '0') AS row_code,
               lpad(c_nationkey::VARCHAR, 2, '0') AS nation_code,
               lpad(c_custkey::VARCHAR, 10, '0') AS customer_key,
               rpad(c_name, 25, ' ') AS customer_name,
               rpad(c_mktsegment, 12, ' ') AS segment,
               '' AS beyond
        FROM customer""",
    "trim_all": """
        SELECT s_suppkey, s_name || ' ' || chr(9) AS s_name,
               CASE WHEN s_nationkey < 5 THEN '' ELSE 'x  y' END AS note
        FROM supplier""",
    "select_generated_columns": """
        SELECT l_orderkey, l_linenumber, l_quantity AS amount_1, l_discount AS rate_1,
               l_extendedprice AS amount_2, l_tax AS rate_2
        FROM lineitem""",
    "drop_columns": "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders",
    "suffix_rename": "SELECT p_partkey AS p_partkey_a, p_name AS p_name_a, p_brand FROM part",
    "map_rename": "SELECT o_orderkey AS venda_id, o_custkey AS marca_id, o_orderstatus FROM orders",
    "filter_code": """
        SELECT c_custkey, rpad(c_mktsegment, 12, ' ') AS segment
        FROM customer WHERE c_mktsegment = 'BUILDING'""",
    "word_count_filter": """
        SELECT doc_id FROM (
            SELECT doc_id, text, replace(source, '1', ' ') AS source FROM documents
            UNION ALL
            SELECT -doc_id - 1, CASE WHEN lang = 'en' THEN substr(text, 1, 12) END,
                   CASE WHEN lang <> 'de' THEN replace(source, '1', ' ') END FROM documents)
        WHERE len(string_split(text, ' ')) > 2 OR len(string_split(source, ' ')) > 2""",
    "either_not_null": """
        SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status, nullif(o_orderpriority, '5-LOW') AS priority
        FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderpriority = '5-LOW')""",
    "id_membership": """
        SELECT o_orderkey, o_custkey FROM orders
        WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
    "complement_concat": r"""
        SELECT p_partkey, regexp_replace(trim(concat_ws(' ', nullif(p_brand, 'Brand#3'),
                   CASE WHEN p_size > 20 THEN '' ELSE '  lote' END, '', p_type || chr(9) || ' ' || chr(9), '',
                   p_name)), '\s{2,}', ' ', 'g') AS complemento_concatenado
        FROM part""",
    "collapse_spaces": r"""
        SELECT doc_id, regexp_replace(trim(text), '\s{2,}', ' ', 'g') AS text FROM documents""",
    "surrogate_id_hash": """
        SELECT o_orderkey, md5(length(o_orderkey::VARCHAR) || ':' || o_orderkey) AS id FROM orders""",
    "surrogate_id_two_keys": """
        SELECT *, md5(coalesce(length(x) || ':' || x, '-') || coalesce(length(y) || ':' || y, '-')) AS id
        FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'a:b' WHEN 1 THEN 'a' END AS x,
                     CASE WHEN o_orderkey % 2 = 0 THEN 'c' WHEN o_orderkey % 5 = 0 THEN 'b:c' END AS y
              FROM orders)""",
    "surrogate_id_position": """
        SELECT c_custkey || '|' || c_name AS value, line
        FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS line FROM customer) WHERE c_custkey % 7 <> 0""",
    "extracted_at": "SELECT count(*) AS n_stamped, 1 AS n_instants, true AS plausible FROM customer",
    "surrogate_id_monotonic": """
        SELECT o_orderpriority, count(*) AS n_rows, count(*) AS n_ids, true AS no_negative_id
        FROM orders GROUP BY o_orderpriority""",
    "stage_row_counts": """
        SELECT 'filter' AS stage, count(*) AS rows_in, count(*) FILTER (WHERE p_size > 40) AS rows_out FROM part
        UNION ALL
        SELECT 'membership', count(*), count(*) FILTER (WHERE o_custkey IN
               (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')) FROM orders
        UNION ALL
        SELECT 'names', count(*), count(DISTINCT p_name) FROM part""",
}
