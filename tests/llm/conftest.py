import pytest


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    """doc_id -> text of the whole table."""
    return {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}


@pytest.fixture
def odd(spark):
    """Documents with nulls in every column, empty, blank, long and repeated texts, ties, repeated rows and
    extra columns whose names the operators use themselves."""
    long = "word " * 30_000 + "end"
    rows = [
        (1, "alpha beta gamma delta epsilon", "en", "a", 30, "x", 1),
        (2, "alpha beta gamma delta epsilon", "en", "b", 30, "x", 1),
        (2, "alpha beta gamma delta epsilon", "en", "b", 30, "x", 1),
        (3, "", "en", "a", 0, None, 1),
        (4, None, None, None, None, None, None),
        (None, "no id, but a text of its own", "en", "a", 28, "x", 1),
        (None, None, None, None, None, None, None),
        (5, " \t\n", "fr", None, 3, "x", 2),
        (6, long, "en", "a", len(long), "x", 2),
        (7, "Ünïcødé 日本語 🙂\r\nline two\n\nline three", "de", "c", 30, "x", 2),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, digest long"
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def empty(odd):
    return odd.limit(0)
