"""Nested result pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.functions.text import mentions
from matchloom.operators.pages import (
    flatten_episodes,
    flatten_shows,
    good_pages,
    ids_by_name,
    joined_ids,
    page_completeness,
    rejected_pages,
)
from matchloom.plans.podcast import podcast_mentions
from matchloom.sources.pages import EPISODE_PAGE, SHOW_PAGE, read_pages
from workload.inputs import (
    ORDER_PAGES_SQL,
    episode_pages,
    order_pages,
    show_pages,
    table,
    write_lines,
)

PHRASE = "[tT]h(is|e) [a-p]"
SHOW = "Show src1"


def _orders(spark, sf):
    path = write_lines(order_pages(table(spark, sf, "orders")), "order-pages")
    return read_pages(spark, path, EPISODE_PAGE)


def _shows(spark, sf):
    path = write_lines(show_pages(table(spark, sf, "documents")), "show-pages")
    return read_pages(spark, path, SHOW_PAGE)


def json_pages_scan(spark, sf):
    return _orders(spark, sf).select(
        "feed", "offset", "total", F.size("items").alias("n_items"), F.col("error.message").alias("message")
    )


def flatten_items(spark, sf):
    return flatten_shows(_shows(spark, sf))


def flatten_pages(spark, sf):
    return flatten_episodes(good_pages(_orders(spark, sf)), ["feed"])


def _troubled(spark, sf):
    """The order pages, with some landed twice, some cut off, and feeds of failures alone."""
    lines = order_pages(table(spark, sf, "orders"))
    feed = F.get_json_object("value", "$.feed").cast("bigint")
    offset = F.get_json_object("value", "$.offset")
    twice = lines.filter((feed % 5 == 0) & (offset == "0"))
    cut_off = lines.filter((feed % 7 == 0) & (offset == "0")).select(
        F.expr("substring(value, 1, length(value) - 3)").alias("value")
    )
    lost = lines.filter((feed % 11 == 0) & (offset == "0")).select(
        F.format_string('{"error": {"status": 500, "message": "gone"}, "feed": "lost-%d"}', feed).alias("value")
    )
    path = write_lines(lines.unionByName(twice).unionByName(cut_off).unionByName(lost), "troubled-pages")
    return read_pages(spark, path, EPISODE_PAGE)


def page_quality(spark, sf):
    """Verdicts by feed; what a broken document says of its feed is not used."""
    pages = _troubled(spark, sf)
    known = F.when(F.col("problem") != "broken document", F.col("feed")).alias("feed")
    return (
        good_pages(pages)
        .select("feed", F.lit("good").alias("verdict"))
        .unionByName(rejected_pages(pages).select(known, F.col("problem").alias("verdict")))
        .groupBy("feed", "verdict")
        .agg(F.count("*").alias("n_pages"))
    )


def feed_completeness(spark, sf):
    return page_completeness(_troubled(spark, sf))


def mention_filter(spark, sf):
    documents = table(spark, sf, "documents")
    return documents.filter(mentions(F.col("text"), PHRASE)).select("doc_id", "lang")


def lookup_ids(spark, sf):
    return ids_by_name(flatten_shows(_shows(spark, sf)), SHOW)


def ids_of_names(spark, sf):
    return joined_ids(flatten_shows(_shows(spark, sf)))


def _podcast(spark, sf):
    episodes = write_lines(episode_pages(table(spark, sf, "documents")), "episode-pages")
    return podcast_mentions(_shows(spark, sf), read_pages(spark, episodes, EPISODE_PAGE), SHOW, PHRASE)


def podcast_shows(spark, sf):
    return _podcast(spark, sf).shows


def podcast_episodes(spark, sf):
    return _podcast(spark, sf).episodes


def podcast_mentioned(spark, sf):
    return _podcast(spark, sf).mentions


QUERIES = {
    "json_pages_scan": json_pages_scan,
    "flatten_items": flatten_items,
    "flatten_pages": flatten_pages,
    "page_quality": page_quality,
    "page_completeness": feed_completeness,
    "mention_filter": mention_filter,
    "lookup_ids": lookup_ids,
    "joined_ids": ids_of_names,
    "podcast_shows": podcast_shows,
    "podcast_episodes": podcast_episodes,
    "podcast_mentions": podcast_mentioned,
}

_SHOWS = """
    SELECT source AS show_id, 'Show ' || substr(source, 1, 4) AS show_name,
           'All about ' || source AS show_description, count(*) AS show_total_episodes
    FROM documents GROUP BY source"""
_EPISODES = f"""
    SELECT doc_id::VARCHAR AS episode_id, text AS episode_description, n_chars AS episode_duration,
           lang AS episode_release_date
    FROM documents WHERE 'Show ' || substr(source, 1, 4) = '{SHOW}'"""
_MENTIONS = rf"(^|[^\p{{L}}\p{{N}}_]){PHRASE}"

ORACLE = {
    "json_pages_scan": f"""WITH {ORDER_PAGES_SQL}
        SELECT feed::VARCHAR AS feed, CASE WHEN NOT failed THEN page * 50 END AS "offset",
               CASE WHEN NOT failed THEN total END AS total,
               CASE WHEN NOT failed THEN n::INT END AS n_items,
               CASE WHEN failed THEN 'try later' END AS message
        FROM pages JOIN totals USING (feed)""",
    "flatten_items": _SHOWS,
    "flatten_pages": f"""WITH {ORDER_PAGES_SQL}
        SELECT feed::VARCHAR AS feed, o_orderkey::VARCHAR AS episode_id,
               o_orderpriority || ' ' || o_orderstatus AS episode_description,
               o_custkey AS episode_duration, o_orderstatus AS episode_release_date
        FROM numbered JOIN pages USING (feed, page) WHERE NOT failed""",
    "page_quality": f"""WITH {ORDER_PAGES_SQL},
        verdicts AS (
            SELECT feed::VARCHAR AS feed, CASE WHEN failed THEN 'try later' ELSE 'good' END AS verdict FROM pages
            UNION ALL
            SELECT feed::VARCHAR, 'good' FROM pages WHERE feed % 5 = 0 AND page = 0 AND NOT failed
            UNION ALL
            SELECT NULL, 'broken document' FROM pages WHERE feed % 7 = 0 AND page = 0 AND NOT failed
            UNION ALL
            SELECT 'lost-' || feed, 'gone' FROM pages WHERE feed % 11 = 0 AND page = 0 AND NOT failed
        )
        SELECT feed, verdict, count(*) AS n_pages FROM verdicts GROUP BY ALL""",
    "page_completeness": f"""WITH {ORDER_PAGES_SQL},
        landed AS (SELECT feed, coalesce(sum(n) FILTER (WHERE NOT failed), 0)::BIGINT AS rows_landed,
                          count(*) FILTER (WHERE NOT failed) AS pages_landed
                   FROM pages GROUP BY feed),
        known AS (SELECT feed, CASE WHEN pages_landed > 0 THEN total END AS total, rows_landed, pages_landed
                  FROM landed JOIN totals USING (feed))
        SELECT feed::VARCHAR AS feed, total, rows_landed, pages_landed,
               least(total // 50 + 1, 40) AS pages_expected,
               coalesce(rows_landed = total, false) AS rows_complete,
               coalesce(pages_landed = least(total // 50 + 1, 40), false) AS pages_complete
        FROM known
        UNION ALL
        SELECT 'lost-' || feed, NULL, 0, 0, NULL, false, false
        FROM pages WHERE feed % 11 = 0 AND page = 0 AND NOT failed""",
    "mention_filter": f"SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '{_MENTIONS}')",
    "lookup_ids": f"SELECT show_name, show_id FROM ({_SHOWS}) WHERE show_name = '{SHOW}'",
    "joined_ids": f"""
        SELECT show_name, string_agg(show_id, '' ORDER BY show_id) AS show_ids FROM ({_SHOWS}) GROUP BY show_name""",
    "podcast_shows": _SHOWS,
    "podcast_episodes": _EPISODES,
    "podcast_mentions": f"""
        SELECT * FROM ({_EPISODES}) WHERE regexp_matches(episode_description, '{_MENTIONS}')""",
}
