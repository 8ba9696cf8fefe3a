"""SQL that gives the rows of the corpus queries, where SQL can."""

from __future__ import annotations


OP5 = r"""
WITH words AS (
    SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents
    UNION ALL
    SELECT 'i', item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') FROM benchmark
), shingles AS (
    SELECT DISTINCT kind, id,
           w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] || ' ' || w[k + 3] || ' ' || w[k + 4] AS s
    FROM (SELECT kind, id, w, unnest(range(1, len(w) - 3)) AS k FROM words WHERE len(w) >= 5)
), sizes AS (
    SELECT id, count(*) AS n FROM shingles WHERE kind = 'i' GROUP BY id
), shared AS (
    SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared
    FROM shingles d JOIN shingles i ON d.s = i.s AND d.kind = 'd' AND i.kind = 'i'
    GROUP BY d.id, i.id
)
SELECT doc_id, item_id, shared, n AS item_shingles, shared / n AS containment
FROM shared JOIN sizes ON sizes.id = shared.item_id
WHERE 5 * shared >= 4 * n
"""


# Redirects and canonical links join addresses; groups are found by spreading the
# least address until nothing changes. Steps of dots in relative targets are not
# taken here.
OP8 = r"""
WITH RECURSIVE rules(rule_host, rule_path, verdict) AS (
    VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
           ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), shown AS (
    SELECT DISTINCT url, regexp_replace(html, '(?is)<!--.*?(-->|\z)|<script\b[^>]*>.*?(</script\s*>|\z)'
               || '|<style\b[^>]*>.*?(</style\s*>|\z)|<template\b[^>]*>.*?(</template\s*>|\z)'
               || '|<textarea\b[^>]*>.*?(</textarea\s*>|\z)', ' ', 'g') AS html
    FROM pages
), tags AS (
    SELECT url, 'href' AS name, html, unnest(regexp_extract_all(html, '(?i)<link\s(?:[^>]*\s)?rel\s*=\s*'
               || '(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|''(?:[^'']*\s)?canonical(?:\s[^'']*)?''|canonical[\s/>])[^>]*>?')) AS tag
    FROM shown
    UNION ALL
    SELECT url, 'url', html, unnest(regexp_extract_all(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'))
    FROM shown
), linked AS (
    SELECT url AS source, regexp_extract(tag, '(?i)\b' || name || '\s*=\s*["'']?([^"''\s>]+)', 1) AS raw,
           coalesce(nullif(regexp_extract(html, '(?i)<base\s[^>]*href\s*=\s*["'']?([^"''\s>]+)', 1), ''), url) AS base
    FROM tags
), targets AS (
    SELECT source,
           CASE WHEN raw = '' THEN NULL
                WHEN regexp_matches(raw, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN replace(raw, '&amp;', '&')
                WHEN regexp_matches(raw, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
                WHEN starts_with(raw, '//') THEN regexp_extract(base, '^([^:/?#]*):', 1) || ':' || raw
                WHEN starts_with(raw, '/') THEN regexp_extract(base, '^[^:/?#]*://[^/?#]*', 0) || raw
                WHEN starts_with(raw, '?') THEN regexp_extract(base, '^[^?#]*', 0) || raw
                ELSE regexp_extract(base || CASE WHEN regexp_matches(base, '://[^/?#]*$') THEN '/' ELSE '' END,
                                    '^[^?#]*/', 0) || raw END AS url
    FROM linked
), urls AS (
    SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT url FROM targets) WHERE url IS NOT NULL
), parts AS (
    SELECT url,
           translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
           regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS rest
    FROM (
        SELECT url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM urls
    )
), ruled AS (
    SELECT p.*, r.rule_host || r.rule_path AS rule, r.verdict
    FROM parts p LEFT JOIN rules r
      ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
    QUALIFY row_number() OVER (PARTITION BY p.url
        ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST, length(r.rule_host) DESC) = 1
), addressed AS (
    SELECT *, CASE WHEN host <> '' THEN host || coalesce(nullif(rest, ''), '/') END AS node FROM ruled
), edges AS (
    SELECT a.node AS u, b.node AS v
    FROM targets t JOIN addressed a ON a.url = t.source JOIN addressed b ON b.url = t.url
    WHERE a.node <> b.node
), joined AS (
    SELECT u, v FROM edges UNION SELECT v, u FROM edges
), reach AS (
    SELECT DISTINCT node, node AS other FROM addressed WHERE node IS NOT NULL
    UNION
    SELECT r.node, b.v FROM reach r JOIN joined b ON b.u = r.other
), shared AS (
    SELECT r.node,
           CASE WHEN bool_or(coalesce(a.verdict = 'allow', false)) THEN 'allow'
                WHEN bool_or(coalesce(a.verdict = 'block', false)) THEN 'block' END AS verdict
    FROM reach r JOIN addressed a ON a.node = r.other
    GROUP BY r.node
)
SELECT p.page_id, coalesce(a.host, '') AS host, coalesce(a.path, '') AS path, a.rule,
       coalesce(a.verdict, s.verdict, 'allow') AS verdict
FROM pages p LEFT JOIN addressed a ON a.url = p.url LEFT JOIN shared s ON s.node = a.node
"""


OP12 = r"""
WITH pieces AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w
    FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents
    )
), grams AS (
    SELECT lang, size, array_to_string(w[k : k + size - 1], ' ') AS phrase
    FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS k
          FROM pieces, (VALUES (1), (2), (3), (4)) AS s(size) WHERE len(w) >= size)
), counts AS MATERIALIZED (
    SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
    SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang
), often AS MATERIALIZED (
    SELECT * FROM counts WHERE f >= 30
), candidates AS MATERIALIZED (
    SELECT lang, size, phrase, string_split(phrase, ' ') AS w, f AS a FROM often WHERE size > 1
), cuts AS (
    SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r,
           (2000000 * c.a::HUGEINT // (l.f + r.f))::BIGINT AS score
    FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
    JOIN often l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : c.k], ' ')
    JOIN often r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1 : c.size], ' ')
    QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, c.k) = 1
), inner_phrases AS (
    SELECT lang, array_to_string(w[k : k + n - 1], ' ') AS phrase, max(a) AS longer
    FROM (SELECT lang, w, a, n, unnest(range(1, size - n + 2)) AS k
          FROM candidates, (VALUES (2), (3)) AS s(n) WHERE n < size)
    GROUP BY ALL
), ranked AS (
    SELECT c.*, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, c.phrase) AS rank
    FROM cuts c LEFT JOIN inner_phrases i USING (lang, phrase)
    WHERE i.longer IS NULL OR 100 * i.longer < 80 * c.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_decontaminate": OP5, "op8_url_filter": OP8, "op12_collocations": OP12}
