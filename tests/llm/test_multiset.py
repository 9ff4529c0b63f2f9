import hashlib
import re

import xxhash
from pyspark.sql import functions as F

from matchloom.llm import multiset, queries


def signed(text):
    value = xxhash.xxh64_intdigest(text.encode(), 42)
    return value


def vector(text):
    parts = [p for p in re.split(r"[\n\r]+|(?<=[.!?])\x20+", text) if p]
    lanes = [0] * 126
    for p in parts:
        for half, h in enumerate((signed(p), signed(p + "\n"))):
            for shift in range(21):
                for lane in range(3):
                    lanes[half * 63 + shift * 3 + lane] += h >> (shift + 21 * lane) & 1
    words = [sum(c % 2**20 << 21 * k for k, c in enumerate(lanes[i : i + 3])) for i in range(0, 126, 3)]
    return "".join(f"{w:016x}" for w in [*words, len(parts) % 2**20])


def test_fingerprints_and_edits(spark, sf_dir, texts):
    rows = {r.doc_id: r for r in queries.op3_multiset_hash(spark, sf_dir).collect()}
    ids = sorted(texts)
    assert sorted(rows) == ids
    for k, doc in enumerate(ids):
        text, after = texts[doc], texts[ids[(k + 1) % len(ids)]]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        r = rows[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        if k % 5 == 0:
            assert r.fingerprint == vector(text) and r.edited_fingerprint == vector(edited)
    long = [r for r in rows.values() if r.n_chars > 500]
    assert sum(r.near_edited for r in long) / len(long) > 0.5 > 0.2 > sum(r.near_next for r in long) / len(long)


def test_buckets_do_not_change_the_order(spark):
    rows = spark.range(0, 5000, 7).selectExpr("id * id AS id", "concat('t', id) AS text")
    want = [r.id for r in rows.orderBy("id").collect()]
    found = multiset.with_next(rows, ["id"], rows_per_bucket=50).filter("NOT _lent")
    got = {r.id: r.next_id for r in found.collect()}
    assert got == dict(zip(want, want[1:] + want[:1], strict=True))


def test_insertion_and_deletion(spark):
    one = spark.createDataFrame([("a\nb\nc. d", "c.\ne", "e\na\nd\nb\nc.\nc.")], "a string, b string, both string")
    v = {c: multiset.vector(multiset.parts(F.col(c))) for c in one.columns}
    r = one.select(
        (multiset.union(v["a"], v["b"]) == v["both"]).alias("put"),
        (F.slice(multiset.difference(v["both"], v["b"]), 1, 42) == F.slice(v["a"], 1, 42)).alias("taken"),
        multiset.likeness(v["a"], v["a"]).alias("same"),
    ).first()
    assert tuple(r) == (True, True, 1.0)


def test_odd_rows(odd, empty, spark):
    rows = multiset.edited_fingerprints(odd).collect()
    assert len(rows) == odd.count()
    assert {r.n_chars for r in rows if r.id == 4} == {0}
    assert multiset.edited_fingerprints(empty).collect() == []
    alone = multiset.edited_fingerprints(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()


def test_sums_are_the_vectors(odd):
    rows = odd.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter("doc_id <> 2").distinct()
    parts = rows.select("doc_id", F.explode_outer(multiset.parts(F.col("text"))).alias("p"))
    whole = {r.doc_id: r.v for r in rows.select("doc_id", multiset.vector(multiset.parts(F.col("text"))).alias("v")).collect()}
    assert {r.doc_id: r.vector for r in multiset.summed(parts, ["doc_id"], "p").collect()} == whole
