"""Nested result pages to flat rows, with checks of what was landed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.text import mentions
from matchloom.sources.pages import BROKEN

# Page size of the service and the last offset it serves: fixed values.
PAGE_ROWS = 50
LAST_OFFSET = 1950


class PageError(ValueError):
    """Landed pages that cannot be used."""


def _item_list(pages: DataFrame) -> Column:
    return F.col("shows.items" if "shows" in pages.columns else "items")


def page_problem(pages: DataFrame) -> Column:
    """Why a page cannot be used, null if it can: a broken document, an error page (its message), or a
    page without a list of items (an empty list is one)."""
    return (
        F.when(F.col(BROKEN).isNotNull(), "broken document")
        .when(F.col("error").isNotNull(), F.coalesce("error.message", F.lit("error page")))
        .when(_item_list(pages).isNull(), "no items")
    )


def good_pages(pages: DataFrame) -> DataFrame:
    return pages.filter(page_problem(pages).isNull())


def rejected_pages(pages: DataFrame) -> DataFrame:
    """The other pages, with the ``problem`` of each."""
    return pages.withColumn("problem", page_problem(pages)).filter(F.col("problem").isNotNull())


def require_pages(pages: DataFrame) -> DataFrame:
    """The pages, or an error if there is none or one of them cannot be used."""
    state = (
        pages.select(page_problem(pages).alias("problem"))
        .agg(F.count("*").alias("pages"), F.count("problem").alias("bad"), F.min("problem").alias("why"))
        .first()
    )
    if not state["pages"]:
        raise PageError("no page was landed")
    if state["bad"]:
        raise PageError(f"{state['bad']} error pages, such as: {state['why']}")
    return pages


def _items(pages: DataFrame, items: str, fields: dict[str, str], keep: list[str]) -> DataFrame:
    return pages.select(*keep, F.explode(items).alias("item")).select(
        *keep, *[F.col(f"item.{source}").alias(name) for source, name in fields.items()]
    )


def flatten_shows(pages: DataFrame) -> DataFrame:
    """One row per show of the search pages."""
    return _items(
        pages,
        "shows.items",
        {
            "id": "show_id",
            "name": "show_name",
            "description": "show_description",
            "total_episodes": "show_total_episodes",
        },
        [],
    )


def flatten_episodes(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per episode of all pages; ``keep`` names page columns to carry along."""
    return _items(
        pages,
        "items",
        {
            "id": "episode_id",
            "description": "episode_description",
            "duration_ms": "episode_duration",
            "release_date": "episode_release_date",
        },
        keep or [],
    )


def ids_by_name(shows: DataFrame, name: str) -> DataFrame:
    """The ids of all shows of exactly this name, one per row."""
    return shows.filter(F.col("show_name") == name).select("show_name", "show_id")


def joined_ids(shows: DataFrame) -> DataFrame:
    """``show_name, show_ids``: the ids of all shows of a name, sorted and written one behind the other."""
    return shows.groupBy("show_name").agg(
        F.array_join(F.sort_array(F.collect_list("show_id")), "").alias("show_ids")
    )


def mentioning(episodes: DataFrame, phrase: str) -> DataFrame:
    """Episodes whose description has the phrase at the beginning of a word."""
    return episodes.filter(mentions(F.col("episode_description"), phrase))


def expected_pages(total: Column, page_rows: int = PAGE_ROWS) -> Column:
    """Pages fetched for a feed of ``total`` rows: a last, possibly empty one
    behind the full ones, up to the last offset served."""
    most = LAST_OFFSET // page_rows + 1
    pages = F.least(F.floor(total / page_rows) + 1, F.lit(most)).cast("bigint")
    return F.when(total.isNotNull(), pages)


def page_completeness(pages: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """Per feed that is seen at all: rows and pages landed against those announced. A page landed
    twice counts once, by its offset; a feed of which only failures landed has none of either and an
    unknown total. Pages are brought together by feed and offset before they are summed, so a
    large feed is spread over its pages."""
    usable = page_problem(pages).isNull()
    rows = F.size(_item_list(pages)).cast("bigint")
    landed = (
        pages.filter(F.col("feed").isNotNull())
        .select("feed", F.when(usable, F.col("offset")).alias("offset"), "total", F.when(usable, rows).alias("n"))
        .groupBy("feed", "offset")
        .agg(F.max("total").alias("total"), F.max("n").alias("n"))
        .groupBy("feed")
        .agg(
            F.max("total").alias("total"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows_landed"),
            F.count("n").alias("pages_landed"),
        )
    )
    return landed.select(
        "feed",
        "total",
        "rows_landed",
        "pages_landed",
        expected_pages(F.col("total"), page_rows).alias("pages_expected"),
        F.coalesce(F.col("rows_landed") == F.col("total"), F.lit(False)).alias("rows_complete"),
    ).withColumn("pages_complete", F.coalesce(F.col("pages_landed") == F.col("pages_expected"), F.lit(False)))
