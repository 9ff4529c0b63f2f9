"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0 to 1. Its integral is the source's weight in
the targets; inverted, it tells at which time the demand for the source's words reaches a given
document. Sorting by that time gives the order of training.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import BLANKS, as_row, numbered, of_row, renamed, word_count
from matchloom.session import materialise

ROWS_PER_BUCKET = 10_000


def _segments(knots: list[tuple[float, float]]) -> list[tuple[float, ...]]:
    """``(start, weight there, slope, integral before, integral after)`` of each linear piece."""
    if [knots[0][0], knots[-1][0]] != [0.0, 1.0] or any(w < 0 for _, w in knots):
        raise ValueError("a schedule runs from time 0 to 1 and is nowhere negative")
    out, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        area = (t1 - t0) * (w0 + w1) / 2
        out.append((t0, w0, (w1 - w0) / (t1 - t0), done, done + area))
        done += area
    return out


def schedules(sources: DataFrame, turn: Column, choices: list[list[tuple[float, float]]]) -> DataFrame:
    """``sources`` with the schedule each is given: ``choices[turn % len(choices)]``."""
    arrays = [
        F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip("t w slope before after".split(), s, strict=True)])
                  for s in _segments(knots)])
        for knots in choices
    ]
    pick = arrays[-1]
    for k, a in enumerate(arrays[:-1]):
        pick = F.when(F.pmod(turn, F.lit(len(arrays))) == k, a).otherwise(pick)
    return sources.withColumn("schedule", pick).withColumn("weight", F.element_at("schedule", -1)["after"])


def targets(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """``sources`` (with ``size`` and ``weight``) with their ``target``.

    The budget, ``share`` of all sizes, is divided by weight; what lies above ``max_epochs`` times a
    source's size goes to the others by weight, until none is above. Each round is a sum over the
    sources; only the sums reach the driver.
    """
    cap = F.col("size") * max_epochs
    level, budget, before = None, None, -1
    while True:
        full = F.lit(False) if level is None else (F.col("weight") * level >= cap)
        capped, free, n, total = sources.agg(
            F.sum(F.when(full, cap)),
            F.sum(F.when(~full, F.col("weight"))),
            F.count(F.when(full, 1)),
            F.sum("size"),
        ).first()
        budget = (total or 0) * share if budget is None else budget
        if not free or n == before:
            break
        level, before = max(0.0, budget - (capped or 0.0)) / free, n
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level or 0.0)).cast("double"))


def _position(offset: Column) -> Column:
    """The time at which the demand for the source reaches ``offset`` words."""
    x = offset / F.col("_take") * F.col("weight")
    inside = F.filter("schedule", lambda s: s["after"] > x)
    s = F.when(F.size(inside) > 0, inside[0]).otherwise(F.element_at("schedule", -1))
    y = x - s["before"]
    root = F.sqrt(F.greatest(F.lit(0.0), s["w"] * s["w"] + 2 * s["slope"] * y))
    step = F.when(y <= 0, F.lit(0.0)).otherwise(2 * y / (s["w"] + root))
    return F.least(F.lit(1.0), s["t"] + step)


def mix(
    docs: DataFrame,
    choices: list[list[tuple[float, float]]],
    share: float = 1.0,
    max_epochs: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    row_col: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``, range-sorted by its first training position:
    ``id, source, size, source_size, target, taken, positions``, and first
    ``row``, the key of the row, if ``row_col`` names one.

    ``choices`` are weight schedules, knots ``(time, weight)`` joined by straight lines; the sources,
    in code-point order with null last, take them in turn. A source's documents form a stream ordered by
    a hash of id and text; the stream is read until the source's target, again from its start if the target
    is larger. ``taken`` are the words read of a document, the last one read in part; ``positions``
    are the times of its copies. The running sum within a source is made of sums over hash buckets, so a
    source that holds most rows is spread over as many tasks as it needs.

    Nulls: a null source is a source, a null text is empty, a null id is hashed as such. Empty texts have
    size 0, are never taken and have no position. Repeated rows are documents of their own. A source
    without words has target 0. Empty table: no rows. Other columns are not looked at.
    """
    key = {"row": row_col} if row_col else {}
    given = renamed(docs, id=id_col, text=text_col, source=source_col, **key).select(
        *key, "id", "source", word_count("text").alias("size"), F.xxhash64("id", "text").alias("_h")
    )
    sized = materialise(given, "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    sources = numbered(sources, [F.col("source").asc_nulls_last()], "turn")
    sources = materialise(targets(schedules(sources, F.col("turn"), choices), share, max_epochs), "targets")
    most = sources.agg(F.max("rows")).first()[0] or 0
    bits = max(1, math.ceil(math.log2(max(1, most / ROWS_PER_BUCKET))))

    known = sources.select(
        F.col("source").alias("_source"), "turn", F.col("size").alias("source_size"), "target", "schedule",
        "weight", F.round("target").cast("long").alias("_take"),
    )
    bucket = F.shiftright("_h", 64 - bits).alias("_bucket")
    sums = sized.groupBy("source", bucket).agg(F.sum("size").alias("_sum"))
    sums = sums.select(
        F.col("source").alias("_bs"), F.col("_bucket").alias("_bb"),
        F.expr("sum(_sum) OVER (PARTITION BY source ORDER BY _bucket) - _sum").alias("_before"),
    )
    order = ", ".join(["_h", "id", "size", *key])
    run = F.expr(f"sum(size) OVER (PARTITION BY source, _bucket ORDER BY {order} ROWS UNBOUNDED PRECEDING) - size")
    rows = (
        sized.withColumn("_bucket", bucket)
        .withColumn("_run", run)
        .join(sums, F.col("source").eqNullSafe(F.col("_bs")) & (F.col("_bucket") == F.col("_bb")))
        .join(known, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_start", F.col("_before") + F.col("_run"))
    )
    rounds = F.when(F.col("source_size") > 0, F.expr("_take div source_size")).otherwise(F.lit(0))
    rest = F.col("_take") - rounds * F.col("source_size") - F.col("_start")
    taken = rounds * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), rest))
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    epochs = F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>"))
    positions = F.transform(epochs, lambda e: _position(F.col("_start") + e * F.col("source_size")))
    return (
        rows.withColumn("taken", taken.cast("long"))
        .withColumn("positions", positions)
        .select(*key, "id", "source", "size", "source_size", "target", "taken", "positions")
        .repartitionByRange(F.get("positions", F.lit(0)).asc_nulls_last(), "id")
        .sortWithinPartitions(F.get("positions", F.lit(0)).asc_nulls_last(), "id")
    )


def curriculum(
    docs: DataFrame,
    mixed: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size_col: str | None = "n_chars",
    row_col: str | None = None,
) -> DataFrame:
    """The documents as they are trained on: each copy that ``mixed`` takes, sorted by position, with
    the columns of ``docs`` but ``row_col``. A copy read in part keeps its first words, joined by one blank, and
    ``size_col`` its new length.

    Rows meet their copies by ``row_col``, the key that ``mix`` was given (``common.with_row`` makes one), so ids
    may be null or repeat. Without it they meet by id, and ids that are null or repeat are an error. Texts without words
    are never taken, so null and empty texts are not in the result. Columns may be called anything. Empty table: no rows."""
    if row_col is None:
        ids = mixed.groupBy("id").agg(F.count("*").alias("n"))
        if not ids.filter(F.col("id").isNull() | (F.col("n") > 1)).isEmpty():
            raise ValueError("ids that are null or repeat need a row_col")
    key = "id" if row_col is None else "row"
    copies = mixed.select(
        F.col(key).alias("key"), F.col("size").alias("size"), F.col("taken").alias("taken"),
        F.posexplode("positions").alias("epoch", "position"),
    )
    words = F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size"))
    text = of_row(text_col)
    split = F.split(F.regexp_replace(text, "^" + BLANKS, ""), BLANKS)
    cut = F.when(F.col("words") < F.col("size"), F.concat_ws(" ", F.slice(split, 1, F.col("words").cast("int"))))
    rows = docs.select(as_row(docs)).join(copies, of_row(row_col or id_col) == F.col("key"))
    rows = rows.withColumn("words", words).withColumn("cut", cut.otherwise(text))
    changed = {text_col: F.col("cut")}
    if size_col:
        length = F.length("cut").cast("long")
        changed[size_col] = F.when(F.col("words") < F.col("size"), length).otherwise(of_row(size_col))
    return (
        rows.repartitionByRange("position", of_row(id_col), "key")
        .sortWithinPartitions("position", of_row(id_col), "key", "epoch")
        .select(*[changed.get(c, of_row(c)).alias(c) for c in docs.columns if c != row_col])
    )
