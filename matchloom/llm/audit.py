"""Audit of how five quality filters interact, in whatever order they are applied.

Every document is told by a mask, one bit for each filter it fails, and documents alike in part and mask form a
cell. A recursive query extends the orders filter by filter: each level joins the cells of a part to the prefixes
of the level before, gives what the new filter does there, and carries the bits applied so far.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import BLANKS, renamed, whole_text
from matchloom.session import materialise

LETTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SIGNS = 200, 50, 3, "[#$%&*|]"
#: What a step counts, and the bits of a document's mask it counts them for.
COUNTS = {
    "kept": ("n", "(x.mask & (w.applied | w.next.bit)) = 0"),
    "removed": ("n", "(x.mask & w.next.bit) <> 0 AND (x.mask & w.applied) = 0"),
    "redundant": ("n", "(x.mask & w.next.bit) <> 0 AND (x.mask & w.applied) <> 0"),
    "unique_fails": ("n", "x.mask = w.next.bit"),
    "good_lost": ("good", "(x.mask & w.next.bit) <> 0 AND (x.mask & w.applied) = 0"),
    "toxic_lost": ("toxic", "(x.mask & w.next.bit) <> 0 AND (x.mask & w.applied) = 0"),
}


def _own_failures() -> Column:
    """The bits of the four filters that look at a text alone; ``text`` and its ``words`` are columns."""
    n_words = F.size("words")
    fails = [
        n_words < LEAST_WORDS,
        100 * F.size(F.array_distinct("words")) < DISTINCT_PERCENT * n_words,
        100 * F.regexp_count("text", F.lit("[A-Z]")) > CAPITAL_PERCENT * F.length("text"),
        F.col("text").rlike(SIGNS),
    ]
    mask = F.lit(0)
    for k, fail in enumerate(fails):
        mask = mask + F.when(fail, F.lit(1 << k)).otherwise(F.lit(0))
    return mask


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``good`` and ``toxic``: whether any label of the id says so. Rows without an id have no
    label and take no part in the join."""
    known = (
        labels.filter(F.col("id").isNotNull())
        .groupBy("id")
        .agg(
            F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
            F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
        )
    )
    with_id = rows.filter(F.col("id").isNotNull()).join(known, "id", "left")
    without = rows.filter(F.col("id").isNull())
    return with_id.unionByName(without, allowMissingColumns=True).fillna(False, ["good", "toxic"])


def mask_cells(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
) -> DataFrame:
    """``part, mask, n, good, toxic``: the documents of a part that fail exactly the filters of ``mask``, and
    how many of them ``labels`` (id, quality, toxic) call good and toxic. At most 32 rows a part.

    A text is read once, for the four filters of its own and a SHA-256 digest. Whether a smaller id holds the
    same text is decided on counts: copies are first counted by digest, part, label and id, each combined ahead of
    its shuffle, and only the counts of one text meet, at most four for each part.
    """
    given = renamed(docs, id=id_col, text=text_col, part=part_col).select(
        F.col("id").cast("long").alias("id"),
        F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"),
        whole_text("text").alias("text"),
    )
    words = F.array_remove(F.split("text", BLANKS), "")
    read = given.withColumn("words", words).select(
        "id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), _own_failures().alias("mask")
    )
    rows = _labelled(materialise(read, "masks"), labels)
    kinds = ["digest", "mask", "part", "good", "toxic"]
    by_id = rows.groupBy(*kinds, "id").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "n")).alias("first")
    copies = by_id.groupBy(*kinds).agg(F.sum("n").alias("n"), first)
    least = F.min(F.struct("first.no_id", "first.id")).over(Window.partitionBy("digest"))
    is_first = F.struct("first.no_id", "first.id").eqNullSafe(F.col("least"))
    stays = F.when(is_first, F.col("first.n")).otherwise(F.lit(0))
    split = F.array(
        F.struct(F.col("mask"), stays.alias("n")),
        F.struct((F.col("mask") + F.lit(1 << 4)).alias("mask"), (F.col("n") - stays).alias("n")),
    )
    return (
        copies.withColumn("least", least)
        .select("part", "good", "toxic", F.explode(split).alias("cell"))
        .filter("cell.n > 0")
        .groupBy("part", F.col("cell.mask").alias("mask"))
        .agg(
            F.sum("cell.n").alias("n"),
            F.sum(F.when(F.col("good"), F.col("cell.n")).otherwise(0)).alias("good"),
            F.sum(F.when(F.col("toxic"), F.col("cell.n")).otherwise(0)).alias("toxic"),
        )
    )


def _counted(name: str) -> str:
    of, test = COUNTS[name]
    return f"aggregate(c.cells, CAST(0 AS BIGINT), (sum, x) -> sum + IF({test}, x.{of}, 0)) AS {name}"


def walk(cells: DataFrame) -> DataFrame:
    """``part, prefix, step`` and the counts of ``COUNTS`` for every sequence of one to five different filters: what
    its last filter does to what those before it left. ``cells`` is as ``mask_cells`` gives it.

    A recursive query: level ``step`` extends the prefixes of the level before by each unused letter and joins the
    part's cells, which tell the step's counts; ``applied`` carries the bits. 325 rows a part.
    """
    spark = cells.sparkSession
    by_part = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    by_part = materialise(by_part, "cells")
    letters = ", ".join(f"named_struct('letter', '{x}', 'bit', {1 << k})" for k, x in enumerate(LETTERS))
    none = ", ".join("CAST(0 AS BIGINT)" for _ in COUNTS)
    return spark.sql(
        f"""
        WITH RECURSIVE walk(part, prefix, applied, step, {', '.join(COUNTS)}) AS (
            SELECT part, '', 0, 0, {none} FROM {{cells}}
            UNION ALL
            SELECT w.part, concat(w.prefix, w.next.letter), w.applied | w.next.bit, w.step + 1,
                   {', '.join(map(_counted, COUNTS))}
            FROM (SELECT part, prefix, applied, step,
                         explode(filter(array({letters}), x -> (x.bit & applied) = 0)) AS next
                  FROM walk WHERE step < {len(LETTERS)}) w
            JOIN {{cells}} c ON c.part = w.part
        )
        SELECT part, prefix, step, {', '.join(COUNTS)} FROM walk WHERE step > 0 LIMIT ALL
        """,
        cells=by_part,
    )


def audit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
) -> DataFrame:
    """``part, filter_order, step``, the counts of ``COUNTS`` and ``shapley`` for all 120 orders of the five filters
    and each of their steps: 600 rows a part, zeros included. ``shapley`` is what the step's filter removes,
    summed over all orders.

    Nulls: a null text is an empty one; a null part is the empty string; a null id is larger than every other
    id, not than another null, and has no label; a null label says nothing, and of several labels of an id one
    that says so is enough. Rows alike in id and text are no copies of each other. Empty table: no rows. Other
    columns are not looked at.
    """
    named = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), "quality", "toxic")
    steps = materialise(walk(mask_cells(docs, named, id_col, text_col, part_col)), "steps")
    orders = steps.filter(F.col("step") == len(LETTERS)).select(
        F.col("part").alias("of"),
        F.col("prefix").alias("filter_order"),
        F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(len(LETTERS))), lambda k: F.substring("prefix", F.lit(1), k)))
        .alias("before", "upto"),
    )
    rows = orders.join(steps, (F.col("of") == F.col("part")) & (F.col("upto") == F.col("prefix")))
    rows = rows.withColumn("letter", F.substring("prefix", -1, 1))
    whole = rows.groupBy(F.col("part").alias("p"), F.col("letter").alias("l")).agg(F.sum("removed").alias("shapley"))
    return rows.join(whole, (F.col("part") == F.col("p")) & (F.col("letter") == F.col("l"))).select(
        "part", "filter_order", "step", *COUNTS, "shapley"
    )
