import numpy as np
from pyspark.sql import functions as F

from matchloom.llm import queries, toxicity


def test_held_out_accuracy(spark, sf_dir):
    """At the scale of the tests there are a few dozen held-out toxic texts; labels hold some noise."""
    big = sf_dir.replace("sf0.001", "sf0.01")
    scored = queries.op5_toxicity(spark, big)
    labels = spark.read.parquet(f"{big}/labels.parquet")
    rows = scored.filter("held_out").join(labels, "doc_id").select("toxic", "predicted", "score").collect()
    assert scored.count() == spark.read.parquet(f"{big}/documents.parquet").count()
    right = np.mean([r.toxic == r.predicted for r in rows])
    assert right > 0.93
    toxic = [r.score for r in rows if r.toxic]
    clean = [r.score for r in rows if not r.toxic]
    better = np.mean([t > c for t in toxic for c in clean])
    assert better > 0.85


def test_long_texts_are_read_whole(monkeypatch):
    text = "".join(chr(97 + k * k % 23) for k in range(5000))
    whole = np.unique(np.concatenate(list(toxicity.ngrams(text))))
    monkeypatch.setattr(toxicity, "_CHARS", 100)
    assert np.array_equal(np.unique(np.concatenate(list(toxicity.ngrams(text)))), whole)


def test_counts_are_of_all_rows(spark):
    rows = spark.createDataFrame([("abcd", 1), ("abcd", 0), ("zzabc", 0), (None, 0)], "text string, label int")
    counts = {r.feature: (r.toxic, r.other) for r in toxicity._counts(rows).collect()}
    abc = next(iter(toxicity.ngrams("abcd")))[1]  # between blanks, the second 3-gram
    assert counts[int(abc)] == (1, 2)


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (6, None), (None, 1), (99, 1)], "id long, label int")
    texts = odd.select(F.col("doc_id").alias("id"), "text")
    model = toxicity.train(texts, labels, F.lit(True))
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.id in (3, 4)}) == 1
    assert toxicity.score(empty, model).collect() == []
    kept = toxicity.keep_clean(odd, model, 2.0)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    none = toxicity.train(texts, labels.limit(0), F.lit(True))
    assert max(r.score for r in toxicity.score(odd, none).collect()) < 1e-100


def test_labels_are_no_input_and_held_out_rows_teach_nothing(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").selectExpr("doc_id AS id", "toxic AS label")
    may = ~toxicity.held_out(F.col("id"))
    flipped = labels.withColumn("label", F.when(may, F.col("label")).otherwise(1 - F.col("label")))
    a, b = (toxicity.train(documents, x, may) for x in (labels, flipped))
    assert np.array_equal(a.features, b.features) and np.array_equal(a.weights, b.weights) and a.bias == b.bias
