"""Podcast job: landed pages to shows, episodes and episodes with a mention."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from matchloom.operators.pages import (
    flatten_episodes,
    flatten_shows,
    good_pages,
    ids_by_name,
    mentioning,
    require_pages,
)
from matchloom.sinks.tables import replace_csv
from matchloom.sources.pages import EPISODE_PAGE, SHOW_PAGE, read_pages


class Podcast(NamedTuple):
    shows: DataFrame
    episodes: DataFrame
    mentions: DataFrame


def podcast_mentions(
    show_pages: DataFrame, episode_pages: DataFrame, name: str, phrase: str, strict: bool = False
) -> Podcast:
    """All shows; the episodes of the shows called ``name``; those of them whose
    description mentions the phrase.

    The pages of a feed are found by the show id in ``feed``. Error pages are left
    out, or raise with ``strict``.
    """
    usable = require_pages if strict else good_pages
    shows = flatten_shows(usable(show_pages))
    wanted = ids_by_name(shows, name).select("show_id").distinct().withColumnRenamed("show_id", "feed")
    episodes = flatten_episodes(usable(episode_pages).join(wanted, "feed", "left_semi"))
    return Podcast(shows, episodes, mentioning(episodes, phrase))


def pages_to_csv(
    spark: SparkSession, shows_path: str, episodes_path: str, out: str, name: str, phrase: str
) -> None:
    """Read both kinds of pages and write the three tables below ``out``."""
    result = podcast_mentions(
        read_pages(spark, shows_path, SHOW_PAGE),
        read_pages(spark, episodes_path, EPISODE_PAGE),
        name,
        phrase,
        strict=True,
    )
    for table, df in result._asdict().items():
        replace_csv(df, f"{out.rstrip('/')}/{table}")
