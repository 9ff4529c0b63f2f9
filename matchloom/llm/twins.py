"""The SQL that the audit, the quality rules and the clusters are checked against."""

from __future__ import annotations

from matchloom.llm import divergence, vantage

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

AUDIT = rf"""
WITH texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {WORDS} AS ws FROM documents
), masks AS (
    SELECT doc_id, part,
           (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
           + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t))::INT
           + 8 * regexp_matches(t, '[#$%&*|]')::INT
           + 16 * (coalesce(doc_id, 9223372036854775807)
                   > min(coalesce(doc_id, 9223372036854775807)) OVER (PARTITION BY t))::INT AS mask
    FROM texts
), judged AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), cells AS (
    SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
    FROM masks LEFT JOIN judged USING (doc_id) GROUP BY part, mask
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
    SELECT concat(a.x, b.x, c.x, d.x, e.x) AS o
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
    SELECT o, k, substr(o, k, 1) AS letter, 1 << (ascii(substr(o, k, 1)) - 65) AS bit,
           coalesce(list_sum(list_transform(range(1, k), lambda i: 1 << (ascii(substr(o, i, 1)) - 65))), 0)::INT AS applied
    FROM orders CROSS JOIN (SELECT unnest(range(1, 6))::INT AS k)
), counted AS (
    SELECT part, o AS filter_order, k AS step, letter,
           coalesce(sum(n) FILTER (mask & (applied | bit) = 0), 0)::BIGINT AS kept,
           coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & applied = 0), 0)::BIGINT AS removed,
           coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & applied <> 0), 0)::BIGINT AS redundant,
           coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
           coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & applied = 0), 0)::BIGINT AS good_lost,
           coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & applied = 0), 0)::BIGINT AS toxic_lost
    FROM steps CROSS JOIN cells GROUP BY part, o, k, letter
)
SELECT * EXCLUDE (letter), (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM counted"""

_TERM = (
    "CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END"
)
_CLASSES = [f"length(t) - length(regexp_replace(t, '[{c}]', '', 'g'))" for c in (r"\x20\x09-\x0D", *divergence.CLASSES)]
_NAMED = [f"c{k}" for k in range(len(_CLASSES))]

QUALITY = rf"""
WITH texts AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t, {WORDS} AS ws
    FROM documents
), grams AS (
    SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
    FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM texts)
), again AS (
    SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1
), repeats AS (
    SELECT r, count(DISTINCT i + j) AS n FROM again CROSS JOIN (SELECT unnest([0, 1, 2]) AS j) GROUP BY r
), lines AS (
    SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM texts
), classed AS (
    SELECT r, lang, t, ws, {', '.join(f'{c} AS {n}' for c, n in zip(_CLASSES, _NAMED, strict=True))} FROM texts
), spelt AS MATERIALIZED (
    SELECT r, lang, len(ws) AS n, length(t) AS chars, [{', '.join(_NAMED)}, length(t) - ({' + '.join(_NAMED)})] AS counts
    FROM classed
), counted AS MATERIALIZED (
    SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest(ws) AS w FROM texts WHERE len(ws) >= 50) GROUP BY lang, w
), languages AS MATERIALIZED (
    SELECT lang, CASE WHEN words * {divergence.LANGUAGE_IN} >= sum(words) OVER () THEN lang END AS named
    FROM (SELECT lang, sum(n) AS words FROM counted GROUP BY lang)
), sizes AS (
    SELECT named, sum(n) AS words FROM counted JOIN languages USING (lang) GROUP BY named
), common AS MATERIALIZED (
    SELECT named, w, sum(n) / any_value(words) AS q
    FROM counted JOIN languages USING (lang) JOIN sizes USING (named)
    WHERE regexp_matches(w, '\p{{L}}') GROUP BY named, w HAVING sum(n) * {divergence.COMMON_IN} >= any_value(words)
), class_shares AS (
    SELECT named, k, sum(counts[k + 1]) / sum(chars) AS q
    FROM spelt JOIN languages USING (lang) CROSS JOIN (SELECT unnest(range({len(_CLASSES) + 1})) AS k)
    WHERE n >= 50 GROUP BY named, k
), class_distances AS (
    SELECT r, sqrt(greatest(0, sum({_TERM}) / 2)) AS d
    FROM (SELECT r, counts[k + 1] / chars AS p, q FROM spelt JOIN languages USING (lang) JOIN class_shares USING (named)
          WHERE chars >= {divergence.LEAST_CHARS})
    GROUP BY r
), shares AS MATERIALIZED (
    SELECT r, len(list_filter(ws, lambda x: x = w)) / len(ws) AS p, q
    FROM texts JOIN languages USING (lang) JOIN common USING (named) WHERE len(ws) >= {divergence.LEAST_WORDS_TOLD}
), word_distances AS (
    SELECT r, sqrt(greatest(0, sum({_TERM}) / 2)) AS d
    FROM (FROM shares UNION ALL SELECT r, 1 - sum(p) AS p, 1 - sum(q) AS q FROM shares GROUP BY r) GROUP BY r
), ruled AS (
    SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
           len(regexp_extract_all(t, '{divergence.SYMBOLS}')) AS n_symbols,
           (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words,
           len(ws) < 50 OR 100 * coalesce(repeats.n, 0) > 50 * len(ws) AS base_failed,
           coalesce(c.d <= {divergence.CLASS_LIMIT}, true) AND coalesce(w.d <= {divergence.WORD_LIMIT}, true) AS near
    FROM texts JOIN lines USING (r) LEFT JOIN repeats USING (r) LEFT JOIN class_distances c USING (r)
    LEFT JOIN word_distances w USING (r)
)
SELECT * EXCLUDE (near), NOT base_failed AND near AS kept FROM ruled"""


def _round(k: int) -> str:
    """CTEs of one assignment ``a<k>`` to the centroids ``c<k>`` and of the centroids after it."""
    many = vantage.CLUSTERS
    return f"""
a{k} AS MATERIALIZED (
    SELECT vec_id, any_value(i.v) AS v,
           min(list_sum(list_transform(list_zip(i.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT * {many} + c.k) AS m
    FROM ints i CROSS JOIN c{k} c GROUP BY vec_id
), p{k} AS (
    SELECT m % {many} AS k, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{k}
), s{k} AS (
    SELECT k, j, sum(x)::BIGINT AS s, count(*) AS n FROM p{k} GROUP BY k, j
), c{k + 1} AS MATERIALIZED (
    SELECT c.k, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN
        (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM s{k} GROUP BY k) m USING (k)
)"""


CLUSTERS = f"""
WITH ints AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {vantage.SCALE})::BIGINT) AS v
    FROM embeddings
    WHERE len(embedding) = {vantage.WIDTH}
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {vantage.WIDTH}
), c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, v FROM ints
    QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id)) <= {vantage.CLUSTERS}
),{','.join(_round(k) for k in range(vantage.ROUNDS + 1))}
SELECT vec_id, (m % {vantage.CLUSTERS})::INT AS cluster, (m // {vantage.CLUSTERS})::BIGINT AS distance,
       (sum(m // {vantage.CLUSTERS}) OVER (PARTITION BY m % {vantage.CLUSTERS}))::BIGINT AS cluster_inertia,
       (sum(m // {vantage.CLUSTERS}) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{vantage.ROUNDS} JOIN c{vantage.ROUNDS} c ON c.k = m % {vantage.CLUSTERS}"""
