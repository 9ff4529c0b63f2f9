import re
from collections import defaultdict

import corpus_pipeline
import pytest

from matchloom.llm import mixing, queries
from matchloom.llm.common import with_row


def water_filled(sizes, weights, share, cap):
    """Targets by source: code-point order, null last; the excess goes to the others by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, full = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] >= cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in full else level * weight[s] for s in names}
        full |= over
        left -= sum(cap * sizes[s] for s in over)


def check(rows, texts, share=1.5, cap=2.0):
    sizes, taken = defaultdict(int), defaultdict(int)
    for source, text in texts:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    targets = water_filled(sizes, [3, 1, 2], share, cap)
    for r in rows:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= cap * r.size
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source])
        assert len(r.positions) == (-(-r.taken // r.size) if r.size else 0)
        assert all(0 <= p <= 1 for p in r.positions) and list(r.positions) == sorted(r.positions)
    assert all(abs(taken[s] - t) <= 0.5 for s, t in targets.items())


def test_table(spark, sf_dir, documents):
    rows = mixing.mix(documents, queries.CURRICULUM, 1.5, 2.0).collect()
    check(rows, [(r.source, r.text) for r in documents.collect()])
    # Sorted by position; rows that are not taken come last.
    firsts = [r.positions[0] if r.positions else 2 for r in rows]
    assert firsts == sorted(firsts)
    again = mixing.mix(documents.repartition(7), queries.CURRICULUM, 1.5, 2.0).collect()
    assert {(r.id, r.taken, *r.positions) for r in rows} == {(r.id, r.taken, *r.positions) for r in again}


def test_schedules_shape_the_mix(spark):
    """With as many words as needed, each source's words up to time t are its integrated schedule."""
    rows = [(k, "w " * 10, s) for k, s in enumerate(["a", "b", "c"] * 400)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), queries.CURRICULUM).collect()
    for source, knots in zip("abc", queries.CURRICULUM, strict=True):
        (_, w0), (_, w1) = knots
        own = [(p, r.target) for r in mixed if r.source == source for p in r.positions]
        for t in (0.25, 0.5, 0.75):
            want = (w0 * t + (w1 - w0) * t * t / 2) / ((w0 + w1) / 2)
            assert sum(p < t for p, _ in own) / len(own) == pytest.approx(want, abs=0.02)


def test_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 16)
    rows = [(k, "w " * (k % 50), "hot" if k % 3 else f"s{k % 5}") for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(mixing.mix(df, queries.CURRICULUM, 1.5, 2.0).collect(), [(s, t) for _, t, s in rows])


def test_odd_rows(odd, empty):
    rows = mixing.mix(odd, queries.CURRICULUM, 1.5, 2.0).collect()
    assert len(rows) == odd.count()
    check(rows, [(r.source, r.text) for r in odd.collect()])
    assert mixing.mix(empty, queries.CURRICULUM, 1.5, 2.0).collect() == []


def test_copies_and_cut_texts(spark):
    df = spark.createDataFrame(
        [(1, " one two  three four ", "a", 21), (2, "x y", "b", 3), (3, "", "b", 0)],
        "doc_id long, text string, source string, n_chars long",
    )
    mixed = mixing.mix(df, [[(0.0, 1.0), (1.0, 1.0)]], share=1.0, max_epochs=2.0)
    assert {r.id: r.taken for r in mixed.collect()} == {1: 3, 2: 3, 3: 0}
    got = sorted((r.doc_id, r.text, r.n_chars) for r in mixing.curriculum(df, mixed).collect())
    assert got == [(1, "one two three", 13), (2, "x", 1), (2, "x y", 3)]


def test_odd_rows_meet_their_own_copies(spark, odd, empty):
    """Null and repeated ids: every copy has its own row's text, cut at its own row's words."""
    more = [(None, f"w{k} " * 7 + "end", "en", "a", 30, str(k), k) for k in range(40)]
    docs = odd.unionByName(spark.createDataFrame(more, odd.schema))
    rows = with_row(docs, "_row")
    mixed = mixing.mix(rows, queries.CURRICULUM, 1.5, 2.0, row_col="_row")
    check(mixed.collect(), [(r.source, r.text) for r in docs.collect()])
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    texts, want = {r["_row"]: r.text for r in rows.collect()}, []
    for r in mixed.collect():
        own = words(texts[r.row])
        want += [(r.id, r.source, own[: min(r.size, r.taken - e * r.size)]) for e in range(len(r.positions))]
    made = mixing.curriculum(rows, mixed, row_col="_row")
    assert made.columns == docs.columns
    got = [(r.doc_id, r.source, words(r.text)) for r in made.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    with pytest.raises(ValueError, match="row_col"):
        mixing.curriculum(docs, mixing.mix(docs, queries.CURRICULUM, 1.5, 2.0))
    assert corpus_pipeline.mixed(spark, empty, "").collect() == []


def test_copies_do_not_grow_with_the_square_of_null_ids(spark):
    docs = spark.createDataFrame(
        [(None, f"w{k} " * 10, "a", 30) for k in range(60)], "doc_id long, text string, source string, n_chars long"
    )
    copies = corpus_pipeline.mixed(spark, docs, "").collect()
    assert len(copies) == 90 and len({r.text for r in copies}) == 60
