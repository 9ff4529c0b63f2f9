"""Samples and draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.functions.draws import hash_choice
from matchloom.operators.sampling import (
    limit_by_hash,
    not_in_draw,
    sample_exact,
    sample_hash,
    sample_rows,
)
from workload.inputs import table


def sample_bernoulli(spark, sf):
    """What can be said of a draw that depends on the layout: its share (within six standard
    errors), no row twice, none that is not in the table."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    drawn = sample_rows(orders, 0.1, 7)
    known = orders.withColumn("known", F.lit(1))
    total = F.lit(orders.count())
    return drawn.join(known, ["o_orderkey", "o_custkey"], "left").agg(
        (F.abs(F.count("*") - 0.1 * total) <= 6 * F.sqrt(0.09 * total)).alias("plausible_share"),
        (F.count("*") == F.countDistinct("o_orderkey")).alias("no_row_twice"),
        (F.count("*") == F.count("known")).alias("all_from_table"),
    )


def sample_by_hash(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return sample_hash(orders, "o_orderkey", 0.1, "7")


def limit_hash_order(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return limit_by_hash(orders, "o_orderkey", 1000, "7")


def sample_exact_k(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return sample_exact(documents, "doc_id", 150, "2", strict=True)


def disjoint_second_draw(spark, sf):
    ids = table(spark, sf, "documents").select("doc_id", "source")
    first = sample_exact(ids, "doc_id", 60, "first")
    return sample_exact(not_in_draw(ids, first, "doc_id"), "doc_id", 90, "second")


def noise_column_choice(spark, sf):
    documents = table(spark, sf, "documents")
    return documents.select(
        "doc_id", hash_choice("2", F.col("doc_id"), ["nome", "complemento", "bairro"]).alias("choice")
    )


QUERIES = {
    "sample_bernoulli": sample_bernoulli,
    "sample_hash": sample_by_hash,
    "limit_hash_order": limit_hash_order,
    "sample_exact_k": sample_exact_k,
    "disjoint_second_draw": disjoint_second_draw,
    "noise_column_choice": noise_column_choice,
}

ORACLE = {
    "sample_bernoulli": "SELECT true AS plausible_share, true AS no_row_twice, true AS all_from_table",
    "sample_hash": """
        SELECT o_orderkey, o_custkey FROM orders
        WHERE ('0x' || substr(md5('7:' || o_orderkey), 1, 8))::BIGINT < floor(0.1::DOUBLE * 4294967296)""",
    "limit_hash_order": """
        SELECT o_orderkey, o_orderstatus FROM orders ORDER BY md5('7:' || o_orderkey) LIMIT 1000""",
    "sample_exact_k": """
        SELECT doc_id, lang, text FROM documents ORDER BY md5('2:' || doc_id) LIMIT 150""",
    "disjoint_second_draw": """
        WITH first AS (SELECT doc_id FROM documents ORDER BY md5('first:' || doc_id) LIMIT 60)
        SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM first)
        ORDER BY md5('second:' || doc_id) LIMIT 90""",
    "noise_column_choice": """
        SELECT doc_id, ['nome', 'complemento', 'bairro'][
                   (('0x' || substr(md5('2:' || doc_id), 1, 8))::BIGINT % 3 + 1)::INT] AS choice
        FROM documents""",
}
