import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from matchloom.llm import exact


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def expected(rows):
    """(id, text) rows -> sorted (id, keep_id, size, kept)."""
    groups = defaultdict(list)
    for doc, text in rows:
        groups[normal(text)].append((-len(text or ""), doc is None, doc or 0, doc))
    out = []
    for members in groups.values():
        members.sort(key=lambda m: m[:3])
        out += [(m[3], members[0][3], len(members), k == 0) for k, m in enumerate(members)]
    return sorted(out, key=str)


@pytest.mark.parametrize("all_digests", [True, False])
def test_groups(documents, odd, all_digests):
    for df in (documents, odd):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        got = exact.exact_groups(df, all_digests=all_digests).collect()
        assert sorted(((r.id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == expected(rows)


def test_equal_lengths_and_prefixes_are_no_copies(spark):
    rows = [(k, "x" * 100 + f"{k % 3:03d}") for k in range(9)] + [(9, "y" * 103), (10, " y" * 103)]
    got = exact.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == expected(rows)


def test_texts_are_read_for_candidates_only(spark):
    rows = [(1, "a"), (2, "bb"), (3, "cc"), (4, "dd d"), (5, "ddd")]
    got = exact.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.id for r in got if r.digest is not None} == {4, 5}


def test_rows_that_stay(odd, empty):
    kept = exact.keep_exact(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert sorted((r.doc_id for r in rows), key=str) == sorted([1, 5, 6, 7, None], key=str)
    assert exact.keep_exact(empty).collect() == exact.exact_groups(empty).collect() == []


def test_hot_group(spark):
    df = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.col("id").cast("string")).alias("text")
    )
    got = exact.exact_groups(df)
    assert got.filter("group_size = 1000 AND keep_id = 0").count() == 1000 and got.filter("kept").count() == 2001
