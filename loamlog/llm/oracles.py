"""SQL twins of the operators' queries, stated from their contracts alone."""

from __future__ import annotations

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

OP4 = f"""
WITH item_words AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT item, w, least(len(w), 10) AS n,
               unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s
        FROM item_words WHERE len(w) > 0)),
doc_words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
doc_windows AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s
        FROM doc_words, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)),
hits AS (SELECT doc_id, s, d.n, item FROM doc_windows d JOIN item_windows i ON d.win = i.win AND d.n = i.n),
places AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS place FROM (SELECT DISTINCT doc_id, s, n FROM hits))
  GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""


OP5 = r"""
WITH lines AS (SELECT doc_id, string_split(text, chr(10)) AS ln FROM documents WHERE text IS NOT NULL),
windows AS (
  SELECT doc_id, s, array_to_string(ln[s:s + 2], chr(10)) AS win
  FROM (SELECT doc_id, ln, unnest(range(1, len(ln) - 1)) AS s FROM lines WHERE len(ln) >= 3)),
ranked AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS rank
  FROM windows WHERE regexp_matches(win, '[^ \t\r\n]')),
gone AS (
  SELECT DISTINCT doc_id, unnest([s, s + 1, s + 2]) AS place FROM ranked WHERE rank > 1),
places AS (SELECT doc_id, unnest(range(1, len(ln) + 1)) AS place, unnest(ln) AS line FROM lines),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY place) AS text, count(*) AS n
  FROM places ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN l.ln IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
       CAST(coalesce(len(l.ln), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(l.ln), 0) - coalesce(kept.n, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN lines l USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP6 = """
WITH rules(verdict, host, path) AS (VALUES
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r
  FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
fits AS (
  SELECT p.page_id, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC) AS rank
  FROM parts p JOIN rules r
  ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id AND f.rank = 1
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_decontamination": OP4,
        "op5_line_dedup": OP5,
        "op6_url_filter": OP6,
    }
