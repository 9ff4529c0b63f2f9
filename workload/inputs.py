"""Tables of the test data, and files made of them in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt evenly over the cores: a small file is one split, and lines made of it are many times as large."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def write_lines(lines: DataFrame, label: str) -> str:
    """Write a one-column frame as text files; the new folder."""
    path = scratch_path(lines.sparkSession, label)
    lines.write.text(path)
    return path


def pad(value: Column | str, width: int) -> Column:
    value = F.lit(value) if isinstance(value, str) else value.cast("string")
    return F.rpad(value, width, " ")


def address_lines(part: DataFrame) -> DataFrame:
    """Parts written as 558-character address records: the name is the street, brand,
    size and type are complements, small parts lie in municipality 27408."""
    code = F.when(F.col("p_size") <= 40, F.lit("27408")).otherwise(F.lit("33307"))
    return part.select(
        F.concat(
            F.lit("29"),
            code,
            F.lit("05000001"),
            F.lit("1"),
            pad(" RUA", 20),
            pad("", 30),
            pad(F.col("p_name"), 60),
            pad(F.col("p_size"), 8),
            pad("", 6),
            F.lit("#"),
            pad(F.col("p_brand"), 20),
            pad(F.concat(F.lit("  "), F.col("p_size").cast("string")), 10),
            pad("", 30),
            pad(F.col("p_type"), 20),
            pad("", 10),
            pad("", 90),
            pad("", 30),
            pad("", 120),
            F.lit("01"),
            pad("", 40),
            F.lit("1"),
            pad(F.col("p_partkey"), 30),
            F.lit("001"),
            F.lit("002"),
            F.lit("40000000"),
        ).alias("value")
    )


# The same records field by field, for the checks.
ADDRESS_SQL = """
addresses AS (
    SELECT p_partkey AS k,
           '29' || CASE WHEN p_size <= 40 THEN '27408' ELSE '33307' END || '05000001' AS setor_censitario,
           '29' AS codigo_uf,
           CASE WHEN p_size <= 40 THEN '27408' ELSE '33307' END AS codigo_municipio,
           '05' AS codigo_distrito, '00' AS codigo_subdistrito, '0001' AS codigo_setor,
           '1' AS situacao_setor, rpad(' RUA', 20, ' ') AS tipo_logradouro,
           repeat(' ', 30) AS titulo_logradouro, rpad(p_name, 60, ' ') AS nome_logradouro,
           rpad(p_size::VARCHAR, 8, ' ') AS numero_logradouro, repeat(' ', 6) AS modificador_numero,
           rpad(p_brand, 20, ' ') AS complemento_elemento_1,
           rpad('  ' || p_size, 10, ' ') AS complemento_valor_1,
           repeat(' ', 20) AS complemento_elemento_2, repeat(' ', 10) AS complemento_valor_2,
           rpad(p_type, 20, ' ') AS complemento_elemento_3, repeat(' ', 10) AS complemento_valor_3,
           repeat(' ', 20) AS complemento_elemento_4, repeat(' ', 10) AS complemento_valor_4,
           repeat(' ', 20) AS complemento_elemento_5, repeat(' ', 10) AS complemento_valor_5,
           repeat(' ', 20) AS complemento_elemento_6, repeat(' ', 10) AS complemento_valor_6,
           repeat(' ', 15) AS latiturde, repeat(' ', 15) AS longitude,
           repeat(' ', 60) AS localicade, repeat(' ', 60) AS nulo, '01' AS especie_endereco,
           repeat(' ', 40) AS identificacao_estabelecimento, '1' AS indicador_endereco,
           rpad(p_partkey::VARCHAR, 30, ' ') AS identificacao_domicilio_coletivo,
           '001' AS numero_quadra, '002' AS numero_face, '40000000' AS cep
    FROM part
)"""


def order_pages(orders: DataFrame) -> DataFrame:
    """Result pages of orders as JSON: feeds of 120 order keys, pages of 50. A page
    that begins with an urgent open order is an error page."""
    key = F.col("o_orderkey")
    feed = F.floor(key / 120).cast("bigint")
    numbered = orders.withColumn("feed", feed).withColumn(
        "page", F.floor((key - feed * 120) / 50).cast("bigint")
    )
    totals = numbered.groupBy("feed").agg(F.count("*").alias("total"))
    item = F.struct(
        key.cast("string").alias("id"),
        F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("description"),
        F.col("o_custkey").alias("duration_ms"),
        F.col("o_orderstatus").alias("release_date"),
    )
    pages = numbered.groupBy("feed", "page").agg(
        F.collect_list(item).alias("items"),
        F.min_by(F.concat("o_orderstatus", "o_orderpriority"), key).alias("first"),
    )
    failed = F.col("first") == "O1-URGENT"
    return pages.join(totals, "feed").select(
        F.when(
            failed,
            F.to_json(
                F.struct(
                    F.struct(F.lit(503).alias("status"), F.lit("try later").alias("message")).alias("error"),
                    F.col("feed").cast("string").alias("feed"),
                )
            ),
        )
        .otherwise(
            F.to_json(
                F.struct(
                    F.col("feed").cast("string").alias("feed"),
                    (F.col("page") * 50).alias("offset"),
                    "total",
                    "items",
                )
            )
        )
        .alias("value")
    )


ORDER_PAGES_SQL = """
numbered AS (
    SELECT *, (o_orderkey // 120) AS feed, ((o_orderkey % 120) // 50) AS page FROM orders
), pages AS (
    SELECT feed, page, count(*) AS n, arg_min(o_orderstatus || o_orderpriority, o_orderkey) = 'O1-URGENT' AS failed
    FROM numbered GROUP BY feed, page
), totals AS (
    SELECT feed, count(*) AS total FROM numbered GROUP BY feed
)"""


def show_pages(documents: DataFrame) -> DataFrame:
    """Search pages: a show per document source, several shows of one name."""
    shows = documents.groupBy("source").agg(F.count("*").alias("total_episodes"))
    item = F.struct(
        F.col("source").alias("id"),
        F.concat(F.lit("Show "), F.substring("source", 1, 4)).alias("name"),
        F.concat(F.lit("All about "), F.col("source")).alias("description"),
        "total_episodes",
    )
    return (
        shows.groupBy(F.substring(F.md5("source"), 1, 4).alias("page"))
        .agg(F.struct(F.collect_list(item).alias("items")).alias("shows"))
        .select(F.to_json(F.struct("shows")).alias("value"))
    )


def episode_pages(documents: DataFrame) -> DataFrame:
    """Episode pages: a document per episode with its whole text, 50 at most a page."""
    item = F.struct(
        F.col("doc_id").cast("string").alias("id"),
        F.col("text").alias("description"),
        F.col("n_chars").alias("duration_ms"),
        F.col("lang").alias("release_date"),
    )
    pages = documents.groupBy("source", F.floor(F.col("doc_id") / 50).alias("page")).agg(
        F.collect_list(item).alias("items")
    )
    totals = documents.groupBy("source").agg(F.count("*").alias("total"))
    return pages.join(totals, "source").select(
        F.to_json(
            F.struct(F.col("source").alias("feed"), (F.col("page") * 50).alias("offset"), "total", "items")
        ).alias("value")
    )
