"""Quality rules that compare a document with its language.

Two histograms of a text, of its classes of characters and of its language's common words, are held against those
of the whole language by the Jensen-Shannon distance; a text too short to tell is not judged. Counted rules on words,
lines and repeats come first. Everything is a column expression; no function runs in Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import BLANKS, renamed, whole_text
from matchloom.session import materialise

SYMBOLS = r"[#*$%&|<>]"
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: Classes of characters: lower, upper, digit, ASCII mark. Blanks come before them, all others behind.
CLASSES = ["a-z", "A-Z", "0-9", r"!-/:-@\[-`{-~"]
COMMON_IN = 200  # a word is common if it is at least one in so many of its language, so there are no more such words
LANGUAGE_IN = 1000  # languages with fewer words than one in so many of all share one reference
CLASS_LIMIT, WORD_LIMIT = 0.28, 0.25  # greatest distances of a document that is kept
LEAST_CHARS, LEAST_WORDS_TOLD = 200, 100  # shorter texts are not judged by their classes, by their words


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often and in whatever lambda ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of three consecutive words found twice or more in the text.

    Windows are told apart by a 64-bit hash of their words. If some are alike, the hashes are sorted along with their
    places, so that equal ones are neighbours; the places of those with an equal neighbour, in order, cover three words
    each, fewer where the next one starts earlier.
    """
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
    hashes = F.transform(starts, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def covered(places: Column) -> Column:
        gaps = F.zip_with(places, F.slice(places, F.lit(2), F.size(places)), lambda a, b: F.coalesce(b - a, F.lit(3)))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + F.least(gap, F.lit(3)))

    def repeated(ranked: Column) -> Column:
        like = lambda i, x: F.coalesce(F.get(ranked, i)["window"] == x["window"], F.lit(False))
        twice = F.filter(ranked, lambda x, i: like(i - 1, x) | like(i + 1, x))
        return bound(F.sort_array(F.transform(twice, lambda x: x["place"])), covered)

    def counted(windows: Column) -> Column:
        placed = F.transform(windows, lambda h, i: F.struct(h.alias("window"), i.alias("place")))
        some = F.size(F.array_distinct(windows)) < F.size(windows)
        return F.when(some, bound(F.sort_array(placed), repeated)).otherwise(F.lit(0))

    return bound(hashes, counted).cast("long")


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def with_class_counts(texts: DataFrame, blank_free: Column) -> DataFrame:
    """``texts`` with ``counts``: the characters of ``text`` of each class, blanks first, the rest last. Each class is
    taken out of what the one before left, so that little text is gone through more than once."""
    left = texts.withColumn("left", blank_free)
    left, known = left.withColumn("count_", F.length("text") - F.length("left")), ["count_"]
    for k, c in enumerate(CLASSES):
        left = left.withColumn("less", F.regexp_replace("left", f"[{c}]+", ""))
        known.append(f"count_{k}")
        left = left.withColumn(known[-1], F.length("left") - F.length("less"))
        left = left.drop("left").withColumnRenamed("less", "left")
    counts = F.array(*known, F.length("left")).alias("counts")
    return left.select(*texts.columns, counts)


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence, in bits, of two arrays of shares: 0 to 1."""
    part = lambda x, both: F.when(x > 0, x * F.log2(2 * x / both)).otherwise(F.lit(0.0))
    parts = F.zip_with(p, q, lambda x, y: part(x, x + y) + part(y, x + y))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda total, x: total + x) / 2))


def language_references(texts: DataFrame) -> DataFrame:
    """``language, classes, common, shares``: of every language with a thousandth of the words and more, and of all
    others together (a null), the shares of the character classes, the common words and their shares, the share of all
    other words last. ``texts`` has ``language``, ``text`` and ``words``; texts below LEAST_WORDS words are left out.

    The corpus is read once, for how often each language has each word and, under a null, blanks; everything else
    follows from these counts. At most LANGUAGE_IN + 1 rows of at most COMMON_IN words are returned, whatever the
    data: the rest would add up to more than all.
    """
    blanks = F.length("text") - F.length(F.array_join("words", ""))
    told = texts.filter(F.size("words") >= LEAST_WORDS).select(
        "language", blanks.alias("blanks"), F.concat("words", F.array(F.lit(None))).alias("words")
    )
    told = told.select("language", "blanks", F.explode("words").alias("word"))
    n = F.sum(F.when(F.col("word").isNull(), F.col("blanks")).otherwise(F.lit(1)))
    counts = materialise(told.groupBy("language", "word").agg(n.alias("n")), "word-counts")
    of_words = counts.filter(F.col("word").isNotNull()).groupBy("language").agg(F.sum("n").alias("words"))
    every = of_words.agg(F.sum("words")).first()[0] or 0
    large = of_words.filter(F.col("words") * LANGUAGE_IN >= every).select("language", F.col("language").alias("named"))
    counts = counts.join(F.broadcast(large), "language", "left").groupBy("named", "word").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "language-words")

    names = [f"class_{k}" for k in range(len(CLASSES) + 2)]
    word = F.coalesce("word", F.lit(""))
    spelt = with_class_counts(counts.withColumn("text", word), word).withColumn(
        "counts", F.when(F.col("word").isNull(), F.array(F.lit(1), *[F.lit(0) for _ in names[1:]])).otherwise(F.col("counts"))
    )
    sums = [F.sum(F.col("n") * F.get("counts", F.lit(k))).alias(name) for k, name in enumerate(names)]
    words = F.sum(F.when(F.col("word").isNotNull(), F.col("n"))).alias("words")
    totals = materialise(spelt.groupBy("named").agg(words, *sums), "language-totals")
    of = F.broadcast(totals.select(F.col("named").alias("of"), F.col("words").alias("words_of")))
    common = (
        counts.filter(F.col("word").rlike(r"\p{L}"))
        .join(of, F.col("named").eqNullSafe(F.col("of")))
        .filter(F.col("n") * COMMON_IN >= F.col("words_of"))
        .groupBy("named")
        .agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("common"))
        .select(F.col("named").alias("of"), "common")
    )
    n_chars = sum((F.col(name) for name in names), F.lit(0))
    known = F.aggregate("common", F.lit(0).cast("long"), lambda total, c: total + c["n"])
    shares = F.concat(F.transform("common", lambda c: c["n"] / F.col("words")), F.array((F.col("words") - known) / F.col("words")))
    refs = totals.join(common, F.col("named").eqNullSafe(F.col("of")), "left").withColumn(
        "common", F.coalesce("common", F.array().cast("array<struct<word:string,n:bigint>>"))
    )
    return materialise(
        refs.select(
            F.col("named").alias("language"),
            F.array(*[F.col(name) / n_chars for name in names]).alias("classes"),
            F.transform("common", lambda c: c["word"]).alias("common"),
            shares.alias("shares"),
        ),
        "references",
    )


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    class_limit: float = CLASS_LIMIT,
    word_limit: float = WORD_LIMIT,
) -> DataFrame:
    """``id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance,
    word_distance, kept`` of every row of ``docs``.

    A row fails the counted rules (``base_failed``) with fewer than 50 words or with more than half its words in
    repeated windows of three. Of the others those are kept whose Jensen-Shannon distances to their language
    are at most ``class_limit`` and ``word_limit``. A distance is null, and decides nothing, if the text has fewer
    than LEAST_CHARS characters or LEAST_WORDS_TOLD words, or if there is nothing to compare with.

    The references are made of all texts of 50 words and more: sums and word counts combined ahead of their shuffle.
    Texts themselves are never shuffled; the references, of bounded size, go to them.

    Nulls: a null text is an empty one, a null language the empty one, a null id stays. Repeated rows get a row
    each. Empty table: no rows. Other columns are not looked at.
    """
    given = renamed(docs, id=id_col, text=text_col, language=lang_col).select(
        "id",
        whole_text("text").alias("text"),
        F.coalesce(F.col("language").cast("string"), F.lit("")).alias("language"),
    )
    texts = given.withColumn("words", words_of(F.col("text")))
    refs = language_references(texts)
    own = refs.filter(F.col("language").isNotNull()).withColumnRenamed("language", "of")
    rest = refs.filter(F.col("language").isNull()).first()  # one row, of the small languages together

    def reference(name: str, kind: str) -> Column:
        pooled = F.array(*[F.lit(x) for x in rest[name]]).cast(kind) if rest else F.lit(None).cast(kind)
        return F.coalesce(F.col(name), pooled)

    n = F.size("words")
    n_chars = F.length("text")
    read = with_class_counts(texts, F.array_join("words", "")).join(F.broadcast(own), F.col("language") == F.col("of"), "left").select(
        "id",
        n.cast("long").alias("n_words"),
        (n_chars - F.get("counts", F.lit(0))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        _dup_lines(F.col("text")).alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        _class_distance(n_chars, reference("classes", "array<double>")).alias("class_distance"),
        _word_distance(F.col("words"), reference("common", "array<string>"), reference("shares", "array<double>"))
        .alias("word_distance"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    near = (F.coalesce("class_distance", F.lit(0.0)) <= class_limit) & (
        F.coalesce("word_distance", F.lit(0.0)) <= word_limit
    )
    return read.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & near)


def _class_distance(n_chars: Column, reference: Column) -> Column:
    shares = F.transform("counts", lambda c: c / n_chars)
    return F.when(n_chars >= LEAST_CHARS, js_distance(shares, reference))


def _word_distance(words: Column, common: Column, shares: Column) -> Column:
    n = F.size(words)

    def distance(counts: Column) -> Column:
        known = F.aggregate(counts, F.lit(0), lambda total, c: total + c)
        return js_distance(F.concat(F.transform(counts, lambda c: c / n), F.array((n - known) / n)), shares)

    counts = F.transform(common, lambda w: n - F.size(F.array_remove(words, w)))
    return F.when(n >= LEAST_WORDS_TOLD, bound(counts, distance))
