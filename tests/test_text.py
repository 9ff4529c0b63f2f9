"""Text functions: null, blank and Unicode rules."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchloom.functions.text import any_longer_than, drop_words, join_text, mentions
from matchloom.operators.projection import (
    filter_code,
    numbered,
    rename_columns,
    suffix_columns,
    trim_all,
    with_id,
)


def _one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    "parts, text",
    [
        (["A", None, "", "B"], "A B"),
        (["A", "", "", "B", ""], "A B"),
        ([""] * 12, ""),
        ([None, None], ""),
        (["a \t b"], "a b"),
    ],
)
def test_join_text(spark, parts, text):
    assert _one(spark, join_text(*[F.lit(p).cast("string") for p in parts])) == text


@pytest.mark.parametrize("text", [None, "", "  ", "  \t", "one", " one "])
def test_too_short_texts_stay(spark, text):
    c = F.lit(text).cast("string")
    assert _one(spark, drop_words(c, 2, "s", F.lit(1))) == text


def test_exactly_n_words_leave_nothing(spark):
    assert _one(spark, drop_words(F.lit("a  b"), 2, "s", F.lit(1))) == ""
    assert _one(spark, drop_words(F.lit(" a "), 1, "s", F.lit(1))) == ""


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("aé \t 　\x1fz", max_size=30), min_size=1, max_size=40), st.sampled_from([1, 2]))
def test_dropping_keeps_order_and_number(spark, texts, n):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, t string")
    out = df.select("t", drop_words(F.col("t"), n, "7", F.col("id")).alias("u")).collect()
    for text, got in out:
        words = text.split()
        if not words or len(words) < n:
            assert got == text
            continue
        left = got.split()
        assert got == " ".join(left) and len(left) == len(words) - n
        rest = iter(words)
        assert all(w in rest for w in left)


@pytest.mark.parametrize(
    "text, found",
    [
        ("do Clube História hoje", True),
        ("Clube Historia", True),
        ("-Clube Historia", True),
        ("éClube Historia", False),
        ("_Clube Historia", False),
        ("1Clube Historia", False),
        ("Clube Hist", False),
        (None, False),
    ],
)
def test_mentions(spark, text, found):
    c = F.lit(text).cast("string")
    assert _one(spark, mentions(c, "Clube Hist[oó]ria")) is found


def test_word_counts_split_at_single_spaces(spark):
    df = spark.createDataFrame([(1, "a  b", None), (2, "a b", ""), (3, None, None)], "i int, x string, y string")
    cols = [F.col("x"), F.col("y")]
    assert [r.i for r in df.filter(any_longer_than(cols, 2)).collect()] == [1]
    assert [r.i for r in df.filter(any_longer_than(cols, 1)).orderBy("i").collect()] == [1, 2]


def test_trim_takes_spaces_only_and_leaves_other_types(spark):
    df = spark.createDataFrame([("  a\t ", "   ", 5)], "x string, y string, n int")
    out = trim_all(df)
    assert tuple(out.first()) == ("a\t", "", 5)
    assert out.dtypes == df.dtypes


def test_code_filter_reaches_the_scan_only_if_the_code_fills_the_field(spark, tmp_path):
    path = str(tmp_path / "codes")
    spark.createDataFrame([("27408",), (" 2740",), ("2740 ",)], "code string").write.parquet(path)
    df = spark.read.parquet(path)
    full, part = filter_code(df, "code", "27408", 5), filter_code(df, "code", "2740", 5)
    assert (full.count(), part.count()) == (1, 2)
    assert "EqualTo(code,27408)" in full._jdf.queryExecution().executedPlan().toString()


def test_renaming(spark):
    df = spark.range(1).select("id", F.lit(1).alias("x"))
    assert suffix_columns(df, ["id"], "a").columns == ["id_a", "x"]
    assert rename_columns(df, {"x": "y", "no": "z"}).columns == ["id", "y"]
    assert numbered(["e", "v"], 2) == ["e_1", "v_1", "e_2", "v_2"]


def test_hash_ids_do_not_depend_on_the_layout(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    ids = [sorted(with_id(df.repartition(n), "id", ["k"]).select("k", "id").collect()) for n in (1, 7)]
    assert ids[0] == ids[1] and len({r.id for r in ids[0]}) == 1000
    assert with_id(df.repartition(7)).select("id").distinct().count() == 1000
