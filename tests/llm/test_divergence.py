"""The quality rules against SQL and plain versions of their parts."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from matchloom.llm import divergence, queries
from oracle import connect, difference

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = [r"[\x20\x09-\x0D]", "[a-z]", "[A-Z]", "[0-9]", r"[!-/:-@\[-`{-~]"]


def repeat_words(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    return len({i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(3)})


def dup_lines(text):
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(lines) - len(set(lines))


def distance(p, q):
    term = lambda x, s: x * math.log2(2 * x / s) if x > 0 else 0.0
    return math.sqrt(max(0.0, sum(term(a, a + b) + term(b, a + b) for a, b in zip(p, q, strict=True)) / 2))


def classes(text):
    counts = [len(re.findall(k, text)) for k in KINDS]
    return [*counts, len(text) - sum(counts)]


def references(rows):
    """``language -> (class shares, common words, their shares)`` by plain counting; small languages under None."""
    told = [(lang or "", text or "", WORD.findall(text or "")) for lang, text in rows]
    told = [t for t in told if len(t[2]) >= 50]
    of_language = Counter()
    for lang, _, words in told:
        of_language[lang] += len(words)
    every = sum(of_language.values())
    named = lambda lang: lang if of_language[lang] * 1000 >= every else None
    out = {}
    for key in {named(t[0]) for t in told}:
        own = [t for t in told if named(t[0]) == key]
        counts = Counter(w for t in own for w in t[2])
        total = sum(counts.values())
        common = sorted(w for w, n in counts.items() if n * 200 >= total and any(c.isalpha() for c in w))
        chars = [sum(x) for x in zip(*(classes(t[1]) for t in own), strict=True)]
        shares = [counts[w] / total for w in common]
        out[key] = ([c / sum(chars) for c in chars], common, [*shares, 1 - sum(shares)])
    return out


def plain(text, reference):
    words = WORD.findall(text)
    class_shares, common, shares = reference
    by_class = distance([c / len(text) for c in classes(text)], class_shares) if len(text) >= 200 else None
    by_word = None
    if len(words) >= 100:
        own = [words.count(w) / len(words) for w in common]
        by_word = distance([*own, 1 - sum(own)], shares)
    return by_class, by_word


def test_query_matches_sql(spark, sf_dir):
    name = "op11_distribution_divergence"
    assert difference(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLE[name]) is None


def test_counts_and_distances_match_plain_versions(spark, documents):
    docs = documents.filter("doc_id % 3 = 0")
    rows = {r["doc_id"]: r for r in docs.collect()}
    refs = references([(r["lang"], r["text"]) for r in rows.values()])
    for r in divergence.quality_rules(docs).collect():
        text = rows[r["id"]]["text"] or ""
        words = WORD.findall(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (
            len(words), sum(map(len, words)), len(re.findall(divergence.SYMBOLS, text))
        )
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (dup_lines(text), repeat_words(words))
        by_class, by_word = plain(text, refs[rows[r["id"]]["lang"] or ""])
        assert r["class_distance"] == pytest.approx(by_class)
        assert r["word_distance"] == pytest.approx(by_word)


@pytest.mark.parametrize(
    "text",
    ["", "a", "a b", "a b c", "a b c a b c", "a a a a", "x a b c y a b c a b c z", "a b c d a b c e b c d",
     "line\nline\n\n \nline x\nline", "one\r\ntwo\r\none\r\n"],
)
def test_repeats_of_short_texts(spark, text):
    df = spark.createDataFrame([(text,)], "text string").withColumn("words", divergence.words_of(F.col("text")))
    row = df.select(
        divergence._repeat_words(F.col("words")).alias("r"), divergence._dup_lines(F.col("text")).alias("d")
    ).first()
    assert (row["r"], row["d"]) == (repeat_words(text.split()), dup_lines(text))


def test_distance_is_a_metric_of_shares(spark):
    rows = [([1.0, 0.0], [0.0, 1.0], 1.0), ([0.5, 0.5], [0.5, 0.5], 0.0), ([0.2, 0.8, 0.0], [0.1, 0.0, 0.9], None)]
    for p, q, want in rows:
        got = spark.createDataFrame([(p, q)], "p array<double>, q array<double>").select(
            divergence.js_distance(F.col("p"), F.col("q"))
        ).first()[0]
        assert got == pytest.approx(distance(p, q) if want is None else want)


def test_odd_rows(spark, odd):
    out = divergence.quality_rules(odd).collect()
    assert len(out) == odd.count()
    short = [r for r in out if r["n_words"] < 50]
    assert all(r["base_failed"] and not r["kept"] for r in short)
    long = next(r for r in out if r["id"] == 6)
    assert (long["n_words"], long["n_repeat_words"], long["base_failed"]) == (30_001, 30_000, True)
    assert {r["id"] for r in out} == {1, 2, 3, 4, 5, 6, 7, None}


def test_no_rows_and_no_references(spark, empty, odd):
    assert divergence.quality_rules(empty).collect() == []
    few = odd.filter("doc_id < 4")
    assert [r["class_distance"] for r in divergence.quality_rules(few).collect()] == [None] * 4


def test_what_is_far_from_its_language_goes(spark):
    """Prose stays, symbols and a strange language go; small languages share a reference; short texts are not judged."""
    prose = [f"the cat {i} sat on the mat and the dog {i * 7} of the house went to the town with a friend " * 1 for i in range(40)]
    rows = [(i, " ".join(prose[j] for j in range(i % 5, 40, 5)), "en") for i in range(200)]
    rows.append((1000, " ".join(f"zx{i}#$% qv{i}&*|" for i in range(100)), "en"))
    rows.append((1001, " ".join(f"mot{i} et" for i in range(60)), "en"))
    rows += [(2000 + k, f"uno dos tres cuatro {k} " * 3, f"small{k}") for k in range(5)]
    rows.append((3000, " ".join(f"w{i}###" for i in range(55)), "en"))
    out = {r["id"]: r for r in divergence.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(out[i]["kept"] for i in range(200) if not out[i]["base_failed"])
    assert out[1000]["class_distance"] > divergence.CLASS_LIMIT and not out[1000]["kept"]
    assert out[1001]["word_distance"] > divergence.WORD_LIMIT and not out[1001]["kept"]
    assert out[3000]["word_distance"] is None


def test_small_languages_share_a_reference(spark):
    text = " ".join(f"w{i % 30} the" for i in range(100))
    rows = [(i, text, "en") for i in range(2000)] + [(5000 + k, text, f"l{k}") for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts = df.select(
        F.col("lang").alias("language"), "text", divergence.words_of(F.col("text")).alias("words")
    )
    assert {r["language"] for r in divergence.language_references(texts).collect()} == {"en", None}
    out = divergence.quality_rules(df).filter("id >= 5000").collect()
    assert all(r["word_distance"] == pytest.approx(0.0, abs=1e-6) for r in out)
