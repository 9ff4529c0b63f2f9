"""The registered queries of this package and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import (
    audit,
    divergence,
    exact,
    mixing,
    multiset,
    packing,
    parsing,
    secrets,
    simhash,
    toxicity,
    twins,
    vantage,
    warc,
    windows,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact.exact_groups(_table(spark, sf_dir, "documents"), all_digests=True)
    return groups.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


def op1_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_and_read(_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# Schedules with the means 3, 1 and 2 that the sources weigh: the first kind fades, the last comes up.
CURRICULUM = [[(0.0, 4.0), (1.0, 2.0)], [(0.0, 1.0), (1.0, 1.0)], [(0.0, 1.0), (1.0, 3.0)]]


def op2_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), CURRICULUM, share=1.5, max_epochs=2.0)
    return mixed.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "positions"
    )


SEQUENCE = packing.Limits(tokens=4096, segments=64, loss_tokens=4096)
END_ID = 2


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.pack_documents(_table(spark, sf_dir, "documents"), path, END_ID, SEQUENCE)
    return pieces.select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset",
    )


TOXIC = 0.7


def toxicity_model(documents: DataFrame, spark: SparkSession, sf_dir: str) -> toxicity.Model:
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    texts = documents.select(F.col("doc_id").alias("id"), "text")
    return toxicity.train(texts, labels, ~toxicity.held_out(F.col("id")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    scored = toxicity.score(documents, toxicity_model(documents, spark, sf_dir))
    return scored.select(
        F.col("id").alias("doc_id"), toxicity.held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"),
    )


SHINGLE, RADIUS = 3, 3


def op6_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(_table(spark, sf_dir, "documents"), SHINGLE, RADIUS)
    return groups.select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op3_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = multiset.edited_fingerprints(_table(spark, sf_dir, "documents"))
    return rows.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256",
        multiset.as_text(F.col("vector")).alias("fingerprint"),
        multiset.as_text(F.col("edited_vector")).alias("edited_fingerprint"),
        multiset.likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"),
        multiset.likeness(F.col("vector"), F.col("next_vector")).alias("near_next"),
    )


def op8_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select(
        F.col("id").alias("doc_id"), *[of_kind(k.name) for k in secrets.BASE],
        F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"), "n_live", "n_example",
    )


def op7_prefix_free_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsing.remove_repeated(_table(spark, sf_dir, "documents"), length=50)
    return rows.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op9_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.remove_repeated(_table(spark, sf_dir, "documents"), window=35)
    return rows.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = divergence.quality_rules(_table(spark, sf_dir, "documents"))
    return rows.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def op12_vantage_point_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vantage.clusters(_table(spark, sf_dir, "embeddings"))
    return rows.select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia",
        F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"),
    )


def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_seekable_warc": op1_seekable_warc,
    "op2_curriculum_mix": op2_curriculum_mix,
    "op3_multiset_hash": op3_multiset_hash,
    "op4_vector_packing": op4_vector_packing,
    "op5_toxicity": op5_toxicity,
    "op6_simhash_bktree": op6_simhash_bktree,
    "op7_prefix_free_parse": op7_prefix_free_parse,
    "op8_secret_ownership": op8_secret_ownership,
    "op9_super_kmers": op9_super_kmers,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_distribution_divergence": op11_distribution_divergence,
    "op12_vantage_point_clusters": op12_vantage_point_clusters,
    "op13_filter_interaction_audit": op13_filter_interaction_audit,
}

ORACLE = {
    "op1_seekable_warc": """
        WITH payloads AS (
            SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS bytes FROM pages
        ), marked AS (
            SELECT *, CASE WHEN bytes >= 1000 THEN max(page_id) OVER (PARTITION BY body) END AS first FROM payloads
        )
        SELECT page_id, bytes::BIGINT AS payload_bytes, sha1(body) AS payload_digest,
               CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM marked""",
    "op10_exact_dedup": r"""
        WITH texts AS (
            SELECT doc_id, length(coalesce(text, '')) AS chars,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
            FROM documents
        ), ranked AS (
            SELECT *, first_value(doc_id) OVER (
                       PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id,
                   row_number() OVER (
                       PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST) = 1 AS kept,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM texts
        )
        SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ranked""",
    "op11_distribution_divergence": twins.QUALITY,
    "op12_vantage_point_clusters": twins.CLUSTERS,
    "op13_filter_interaction_audit": twins.AUDIT,
}
