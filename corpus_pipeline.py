"""From the table of documents to packed training sequences, in five stages.

Toxic documents go, of equal texts and of near-equal ones one stays, the sources are mixed to their target
weights along a curriculum, and the mix is packed. Each stage works on all that the one before kept.

In every stage a null text is an empty one, ids may be null or repeat, a null source is a source, further columns stay
whatever they are called, and an empty table gives no rows. Repeated rows are equal texts, of which one stays; texts
without words are not mixed, so none is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import exact, mixing, packing, queries, simhash, toxicity
from matchloom.llm.common import fresh, with_row
from matchloom.session import materialise


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score lies below the operator's threshold."""
    return toxicity.keep_clean(docs, queries.toxicity_model(docs, spark, sf_dir), queries.TOXIC)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space aside."""
    return exact.keep_exact(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints."""
    return simhash.keep_one(docs, queries.SHINGLE, queries.RADIUS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies of documents that the mix takes, in training order."""
    key = fresh(docs, "row_key")
    rows = with_row(docs, key)
    mix = mixing.mix(rows, queries.CURRICULUM, share=1.5, max_epochs=2.0, row_col=key)
    return mixing.curriculum(rows, mix, row_col=key)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences, with their token ids."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.pack_documents(docs, path, queries.END_ID, queries.SEQUENCE)
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("toxicity", clean),
    ("exact dedup", distinct),
    ("SimHash near-dedup", unlike),
    ("mixing sources", mixed),
    ("packing", packed),
]

#: No stage but the second can be said in SQL; tests/llm checks each against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


QUERIES = {"pipeline": run}
ORACLE = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
