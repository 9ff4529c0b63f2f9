"""The audit of filter orders against its SQL and a plain version."""

import itertools
import re

import pytest

from matchloom.llm import audit, queries
from oracle import connect, difference

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, labels):
    """``(part, order, step) -> counts`` by going through every order and row."""

    def fails(row):
        text = row["text"] or ""
        words = WORD.findall(text)
        key = lambda i: (i is None, i or 0)
        copy = any((r["text"] or "") == text and key(r["doc_id"]) < key(row["doc_id"]) for r in rows)
        return {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": copy,
        }

    def labelled(row, k):
        return row["doc_id"] is not None and any(x[0] == row["doc_id"] and x[k] == 1 for x in labels)

    known = [(row["lang"] or "", fails(row), labelled(row, 1), labelled(row, 2)) for row in rows]
    out = {}
    for part in {k[0] for k in known}:
        own = [k for k in known if k[0] == part]
        whole = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [k for k in left if k[1][letter]]
                left = [k for k in left if not k[1][letter]]
                whole[letter] += len(gone)
                failing = [k for k in own if k[1][letter]]
                out[part, "".join(order), step] = [
                    len(left), len(gone), len(failing) - len(gone), sum(sum(k[1].values()) == 1 for k in failing),
                    sum(k[2] for k in gone), sum(k[3] for k in gone),
                ]
        for (of, order, step), counts in out.items():
            if of == part:
                counts.append(whole[order[step - 1]])
    return out


def found(df):
    names = [*audit.COUNTS, "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in df.collect()}


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_query_matches_sql(spark, sf_dir):
    name = "op13_filter_interaction_audit"
    assert difference(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLE[name]) is None


def test_odd_rows_match_a_plain_version(spark, odd):
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (4, None, None), (None, 1, 1), (6, 1, 1), (99, 1, 1)]
    rows = [r.asDict() for r in odd.collect()]
    assert found(audit.audit(odd, labels_of(spark, labels))) == plain(rows, labels)


def test_copies_across_parts_ties_and_nulls(spark):
    long = " ".join(f"w{i}" for i in range(250))
    rows = [(5, long, "en"), (5, long, "en"), (6, long, "de"), (7, long, None), (None, long, ""), (8, None, "en"), (9, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = [(6, 1, 1), (9, 0, 1)]
    cells = {(r["part"], r["mask"]): (r["n"], r["good"], r["toxic"]) for r in audit.mask_cells(
        docs, labels_of(spark, labels).withColumnRenamed("doc_id", "id")).collect()}
    assert cells == {
        ("en", 0): (2, 0, 0), ("de", 16): (1, 1, 1), ("", 16): (2, 0, 0), ("en", 1): (1, 0, 0), ("en", 17): (1, 0, 1)
    }
    given = [dict(zip(("doc_id", "text", "lang"), r, strict=True)) for r in rows]
    assert found(audit.audit(docs, labels_of(spark, labels))) == plain(given, labels)


def test_no_rows(spark, empty):
    assert audit.audit(empty, labels_of(spark, [])).collect() == []


def test_many_parts(spark):
    """More prefixes than a recursive query returns without being told."""
    docs = spark.range(3200).selectExpr("id AS doc_id", "'a b' AS text", "string(id) AS lang")
    assert audit.walk(audit.mask_cells(docs, labels_of(spark, []).withColumnRenamed("doc_id", "id"))).count() == 3200 * 325


@pytest.mark.parametrize("step", range(1, 6))
def test_a_level_has_every_prefix(spark, step):
    cells = spark.createDataFrame([("x", 3, 10, 4, 1)], "part string, mask int, n long, good long, toxic long")
    prefixes = {r["prefix"] for r in audit.walk(cells).filter(f"step = {step}").collect()}
    assert prefixes == {"".join(p) for p in itertools.permutations("ABCDE", step)}
