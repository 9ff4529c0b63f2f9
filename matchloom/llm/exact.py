"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then a hash of
the whole text, each looked at only within the groups that the step before left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import BLANKS, as_row, of_row, renamed
from matchloom.session import materialise

PREFIX_CHARS = 64
SIGNS = ["_length", "_prefix"]


def without_blanks(text: Column) -> Column:
    return F.regexp_replace(text, BLANKS, "")


def _digest(text: Column, normalise: Callable[[Column], Column]) -> Column:
    return F.sha2(normalise(F.coalesce(text, F.lit(""))), 256)


def _signs(text: Column, prefix_chars: int, normalise: Callable[[Column], Column]) -> list[Column]:
    normal = normalise(F.coalesce(text, F.lit("")))
    return [
        F.length(normal).alias("_length"),
        F.xxhash64(F.substring(normal, 1, prefix_chars)).alias("_prefix"),
    ]


def _shared(rows: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose key another row has too."""
    keys = rows.groupBy(*on).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return rows.join(keys, on, "left_semi")


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = PREFIX_CHARS,
    normalise: Callable[[Column], Column] = without_blanks,
    all_digests: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: ``id, n_chars, digest, keep_id, group_size, kept``.

    Of equal normalised texts the one with the most code points before normalising stays, then
    the smallest id. The first pass keeps two numbers of a text, its normalised length and a hash of
    its first ``prefix_chars`` characters. Only rows whose length, then whose pair of both,
    occurs again are read in full and hashed; ``digest`` is null for the others unless
    ``all_digests`` asks for it, in which case one scan makes all three and no text is shuffled.

    Nulls: a null text is an empty one, and empty texts are equal; a null id is a value of its own
    and loses against every other id. Repeated rows: of rows alike in id, digest and length exactly
    one is ``kept``. Empty table: no rows. Other columns of ``docs`` are not looked at.
    """
    given = renamed(docs, id=id_col, text=text_col)
    n_chars = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    signs = _signs(F.col("text"), prefix_chars, normalise)
    digest = _digest(F.col("text"), normalise).alias("digest")
    if all_digests:
        slim = materialise(given.select("id", n_chars.alias("n_chars"), *signs, digest), "exact")
        candidates, rest = _shared(_shared(slim, SIGNS[:1]), SIGNS), slim
    else:
        slim = materialise(given.select("id", n_chars.alias("n_chars"), *signs), "exact")
        keys = _shared(_shared(slim, SIGNS[:1]), SIGNS).select(*SIGNS).distinct()
        whole = given.select("id", "text", n_chars.alias("n_chars"), *signs)
        candidates = whole.join(keys, SIGNS, "left_semi").select("id", "n_chars", digest)
        rest = slim.join(keys, SIGNS, "left_anti").withColumn("digest", F.lit(None).cast("string"))
    return _decided(candidates, rest, all_digests)


def _decided(candidates: DataFrame, rest: DataFrame, overlap: bool) -> DataFrame:
    # Repeated rows are counted before anything is joined, so no step needs the rows of a group
    # together: counts and maxima are combined ahead of every shuffle.
    rows = ["id", "n_chars", "digest"]
    first = F.struct("n_chars", F.col("id").isNotNull(), F.bitwise_not(F.col("id").cast("long")), "id")
    groups = (
        candidates.groupBy("digest")
        .agg(F.max(first).alias("best"), F.count("*").alias("group_size"))
        .filter("group_size > 1")
        .select("digest", F.col("best.id").alias("keep_id"), F.col("best.n_chars").alias("_most"), "group_size")
    )
    every = rest if overlap else candidates.select(*rows).unionByName(rest.select(*rows))
    counted = every.groupBy(*rows).agg(F.count("*").alias("_rows"))
    alone = F.col("group_size").isNull()
    stays = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("_most"))
    return (
        counted.join(groups, "digest", "left")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int"))))
        .select(
            *rows,
            F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            (alone | (stays & (F.col("_copy") == 1))).alias("kept"),
        )
    )


def keep_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, with all their columns, whatever they are called.

    Of rows alike in id and text one stays, the first by its other columns' hash. A null text is an empty one, and a null id
    loses against every other; of empty texts one row stays. Empty table: no rows.
    """
    kept = exact_groups(docs, id_col, text_col, all_digests=True).filter("kept").select("digest", "id", "n_chars")
    text = F.col(f"`{text_col}`")
    own = docs.select(
        as_row(docs),
        _digest(text, without_blanks).alias("own_digest"),
        F.coalesce(F.length(text), F.lit(0)).cast("long").alias("own_chars"),
        F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("own_hash"),
    )
    met = (
        (F.col("own_digest") == F.col("digest"))
        & (F.col("own_chars") == F.col("n_chars"))
        & of_row(id_col).eqNullSafe(F.col("id"))
    )
    same = Window.partitionBy("own_digest", "own_chars", of_row(id_col)).orderBy("own_hash")
    return (
        own.join(kept, met, "left_semi")
        .withColumn("copy", F.row_number().over(same))
        .filter("copy = 1")
        .select("row.*")
    )
