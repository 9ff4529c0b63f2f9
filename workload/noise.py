"""Labelled noise, on whole document texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.functions.text import drop_words
from matchloom.operators.noise import (
    NoiseShares,
    inject_noise,
    label_rows,
    noise_assignments,
    noise_quotas,
)
from workload.inputs import table

# Shares large enough for every kind to show on the small tables.
SHARES = NoiseShares(missing=0.05, one_word=0.1, two_words=0.15)
COLUMNS = ["title", "body"]


def _base(spark, sf):
    """All documents with two text columns, and for every tenth a further row with a title of one
    word and no body."""
    documents = table(spark, sf, "documents")
    title = F.concat_ws(" ", "lang", "source").alias("title")
    nulls = documents.filter("doc_id % 10 = 0").select(
        (-F.col("doc_id") - 1).alias("doc_id"), F.col("lang").alias("title"), F.lit(None).cast("string").alias("body")
    )
    return documents.select("doc_id", title, F.col("text").alias("body")).unionByName(nulls)


def noise_quota(spark, sf):
    return noise_quotas(table(spark, sf, "lineitem"))


def noise_labels(spark, sf):
    noisy = inject_noise(_base(spark, sf), "doc_id", COLUMNS, SHARES)
    return noisy.select("doc_id", "noise_type", "noise_column")


def noise_missing(spark, sf):
    noisy = inject_noise(_base(spark, sf), "doc_id", COLUMNS, NoiseShares(0.3, 0.0, 0.0))
    return noisy.select("doc_id", *[F.col(c).isNull().alias(f"{c}_is_null") for c in COLUMNS], "title")


def noise_injected(spark, sf):
    return inject_noise(_base(spark, sf), "doc_id", COLUMNS, SHARES)


def noise_assignment_join(spark, sf):
    base = _base(spark, sf)
    assigned = noise_assignments(base, "doc_id", COLUMNS, SHARES)
    return label_rows(base.select("doc_id", "title"), assigned, "doc_id")


def _dropped(spark, sf, n):
    return table(spark, sf, "documents").select(
        "doc_id", drop_words(F.col("text"), n, "2", F.col("doc_id")).alias("text")
    )


def noise_drop_one_word(spark, sf):
    return _dropped(spark, sf, 1)


def noise_drop_two_words(spark, sf):
    return _dropped(spark, sf, 2)


QUERIES = {
    "noise_quota": noise_quota,
    "noise_labels": noise_labels,
    "noise_missing": noise_missing,
    "noise_injected": noise_injected,
    "noise_assignment_join": noise_assignment_join,
    "noise_drop_one_word": noise_drop_one_word,
    "noise_drop_two_words": noise_drop_two_words,
}

BLANKS_SQL = (
    r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)


def dropped_sql(source: str, key: str, text: str, n: str, seed: str, prefix: str) -> str:
    """CTEs ending in ``<prefix>dropped (k, text)``: the texts of ``source`` with one
    or two words less. ``n`` and ``seed`` are SQL expressions over ``source``."""
    p = prefix

    def drawn(turn: int) -> str:
        digits = f"substr(md5(seed || ':' || k || ':{turn}'), 1, 8)"
        return f"('0x' || {digits})::BIGINT % greatest(len(ws) - {turn}, 1)"

    return rf"""
{p}split AS (
    SELECT {key} AS k, {text} AS t, {n} AS n, {seed} AS seed,
           list_filter(string_split_regex({text}, '{BLANKS_SQL}'), lambda w: w <> '') AS ws
    FROM {source}
), {p}drawn AS (
    SELECT *, {drawn(0)} AS first, {drawn(1)} AS second FROM {p}split
), {p}words AS (
    SELECT k, n, first, second + (second >= first)::INT AS second, unnest(ws) AS w,
           generate_subscripts(ws, 1) - 1 AS i
    FROM {p}drawn
), {p}kept AS (
    SELECT k, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (WHERE i <> first AND (n = 1 OR i <> second)), '') AS t
    FROM {p}words GROUP BY k
), {p}dropped AS (
    SELECT s.k, CASE WHEN len(s.ws) >= s.n THEN kept.t ELSE s.t END AS text
    FROM {p}split s LEFT JOIN {p}kept kept ON s.k = kept.k
)"""


def groups_sql(base: str, key: str, c1: str, c2: str, missing: float, one: float, two: float) -> str:
    """CTEs ending in ``labelled``: ``base`` with noise_type and noise_column."""

    def words(n: int) -> str:
        return (
            f"(coalesce(len(string_split({c1}, ' ')) > {n}, false)"
            f" OR coalesce(len(string_split({c2}, ' ')) > {n}, false))"
        )

    def choice(kind: str) -> str:
        return (
            f"CASE WHEN ('0x' || substr(md5('2:{kind}:column:' || {key}), 1, 8))::BIGINT % 2 = 0"
            f" THEN '{c1}' ELSE '{c2}' END"
        )

    kinds = ("Supressão de duas palavras", "Supressão de uma palavra", "Valores ausentes")
    return f"""
total AS (SELECT count(*) AS n FROM {base}),
two_ids AS (
    SELECT {key} FROM (SELECT {key}, row_number() OVER (ORDER BY md5('2:{kinds[0]}:' || {key})) AS r
                       FROM {base} WHERE {words(2)}) WHERE r <= (SELECT floor(n * {two}::DOUBLE) FROM total)
), one_ids AS (
    SELECT {key} FROM (SELECT {key}, row_number() OVER (ORDER BY md5('2:{kinds[1]}:' || {key})) AS r
                       FROM {base} WHERE {words(1)} AND {key} NOT IN (SELECT {key} FROM two_ids))
    WHERE r <= (SELECT floor(n * {one}::DOUBLE) FROM total)
), missing_ids AS (
    SELECT {key} FROM (SELECT {key}, row_number() OVER (ORDER BY md5('2:{kinds[2]}:' || {key})) AS r
                       FROM {base} WHERE ({c1} IS NOT NULL OR {c2} IS NOT NULL)
                         AND {key} NOT IN (SELECT {key} FROM two_ids)
                         AND {key} NOT IN (SELECT {key} FROM one_ids))
    WHERE r <= (SELECT floor(n * {missing}::DOUBLE) FROM total)
), typed AS (
    SELECT *, CASE WHEN {key} IN (SELECT {key} FROM missing_ids) THEN '{kinds[2]}'
                   WHEN {key} IN (SELECT {key} FROM one_ids) THEN '{kinds[1]}'
                   WHEN {key} IN (SELECT {key} FROM two_ids) THEN '{kinds[0]}'
                   ELSE 'Sem ruído' END AS noise_type
    FROM {base}
), labelled AS (
    SELECT *, CASE noise_type WHEN '{kinds[2]}' THEN {choice(kinds[2])}
                              WHEN '{kinds[1]}' THEN {choice(kinds[1])}
                              WHEN '{kinds[0]}' THEN {choice(kinds[0])} END AS noise_column
    FROM typed
)"""


def noisy_sql(base: str, key: str, c1: str, c2: str, missing: float, one: float, two: float) -> str:
    """CTEs ending in ``noisy``: ``labelled`` with the noise carried out."""

    def affected(c: str) -> str:
        n = "CASE noise_type WHEN 'Supressão de uma palavra' THEN 1 ELSE 2 END"
        source = f"(SELECT * FROM labelled WHERE noise_column = '{c}' AND noise_type LIKE 'Supress%')"
        return dropped_sql(source, key, c, n, f"'2:{c}'", f"{c}_")

    def column(c: str) -> str:
        return (
            f"CASE WHEN noise_column = '{c}' AND noise_type = 'Valores ausentes' THEN NULL"
            f" WHEN noise_column = '{c}' THEN {c}_dropped.text ELSE labelled.{c} END AS {c}"
        )

    return f"""{groups_sql(base, key, c1, c2, missing, one, two)},
{affected(c1)},
{affected(c2)},
noisy AS (
    SELECT labelled.* REPLACE ({column(c1)}, {column(c2)})
    FROM labelled
    LEFT JOIN {c1}_dropped ON noise_column = '{c1}' AND {c1}_dropped.k = labelled.{key}
    LEFT JOIN {c2}_dropped ON noise_column = '{c2}' AND {c2}_dropped.k = labelled.{key}
)"""


BASE_SQL = """
WITH base AS (
    SELECT doc_id, concat_ws(' ', lang, source) AS title, text AS body FROM documents
    UNION ALL
    SELECT -doc_id - 1, lang, NULL FROM documents WHERE doc_id % 10 = 0
)"""
_SHARES = (SHARES.missing, SHARES.one_word, SHARES.two_words)

ORACLE = {
    "noise_quota": """
        SELECT count(*) AS total, floor(count(*) * 0.01::DOUBLE)::BIGINT AS missing,
               floor(count(*) * 0.02::DOUBLE)::BIGINT AS one_word,
               floor(count(*) * 0.03::DOUBLE)::BIGINT AS two_words
        FROM lineitem""",
    "noise_labels": f"""{BASE_SQL}, {groups_sql('base', 'doc_id', 'title', 'body', *_SHARES)}
        SELECT doc_id, noise_type, noise_column FROM labelled""",
    "noise_missing": f"""{BASE_SQL}, {noisy_sql('base', 'doc_id', 'title', 'body', 0.3, 0.0, 0.0)}
        SELECT doc_id, title IS NULL AS title_is_null, body IS NULL AS body_is_null, title FROM noisy""",
    "noise_injected": f"""{BASE_SQL}, {noisy_sql('base', 'doc_id', 'title', 'body', *_SHARES)}
        SELECT doc_id, title, body, noise_type, noise_column FROM noisy""",
    "noise_assignment_join": f"""{BASE_SQL}, {groups_sql('base', 'doc_id', 'title', 'body', *_SHARES)}
        SELECT doc_id, title, noise_type, noise_column FROM labelled""",
    "noise_drop_one_word": f"""WITH {dropped_sql('documents', 'doc_id', 'text', '1', "'2'", '')}
        SELECT k AS doc_id, text FROM dropped""",
    "noise_drop_two_words": f"""WITH {dropped_sql('documents', 'doc_id', 'text', '2', "'2'", '')}
        SELECT k AS doc_id, text FROM dropped""",
}
