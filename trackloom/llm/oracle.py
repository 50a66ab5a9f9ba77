"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from trackloom.llm.quality import LEAST_DOCS, MIN_LEFT, SHARE

LINE_DEDUP = r"""
WITH d AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS r, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, r, l, unnest(range(0, len(l) - 2)) AS pos FROM d WHERE len(l) >= 3),
g AS (SELECT doc_id, r, pos, l[pos + 1] || chr(10) || l[pos + 2] || chr(10) || l[pos + 3] AS t FROM w),
n AS (SELECT r, pos, row_number() OVER (PARTITION BY t ORDER BY doc_id, pos) AS k FROM g WHERE NOT regexp_full_match(t, '[ \t-\r]*')),
c AS (SELECT DISTINCT r, unnest([pos, pos + 1, pos + 2]) AS p FROM n WHERE k > 1),
e AS (SELECT r, list(p ORDER BY p) AS ps FROM c GROUP BY r),
i AS (SELECT r, list(p ORDER BY p) FILTER (a IS NULL OR a < p - 1) AS heads, list(p + 1 ORDER BY p) FILTER (b IS NULL OR b > p + 1) AS tails
      FROM (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS a, lead(p) OVER (PARTITION BY r ORDER BY p) AS b FROM c) GROUP BY r),
x AS (SELECT d.doc_id, d.text, d.l, e.ps, i.heads, i.tails FROM d LEFT JOIN e USING (r) LEFT JOIN i USING (r))
SELECT doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  coalesce(array_to_string([heads[k] || ':' || tails[k] FOR k IN range(1, len(heads) + 1)], ','), '') AS removed,
  sha256(CASE WHEN ps IS NULL THEN text ELSE array_to_string([l[k + 1] FOR k IN range(0, len(l)) IF NOT list_contains(ps, k)], chr(10)) END) AS text_sha256
FROM x
"""

QUALITY = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, w FROM d WHERE len(w) >= 3),
h AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p], w[p + 1], w[p + 2]) AS n FROM g),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM h WHERE n > 1) GROUP BY doc_id),
ln AS (SELECT doc_id, source, unnest(l) AS raw FROM d),
lf AS (SELECT doc_id, source, raw FROM ln WHERE NOT regexp_full_match(raw, '[\x20\x09-\x0D]*')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n FROM lf GROUP BY doc_id),
nm AS (SELECT doc_id, source, lower(regexp_replace(regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM lf),
ho AS (SELECT source, count(*) AS n FROM d GROUP BY source),
bp AS (SELECT source, line FROM nm JOIN ho USING (source) GROUP BY source, line HAVING count(DISTINCT doc_id) > {LEAST_DOCS} AND 100 * count(DISTINCT doc_id) > {SHARE} * any_value(ho.n)),
gone AS (SELECT doc_id, CAST(sum(len(string_split(line, ' '))) AS BIGINT) AS n FROM nm JOIN bp USING (source, line) GROUP BY doc_id),
b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_boilerplate_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - n_boilerplate_words) >= {MIN_LEFT} * n_words AS kept FROM b
"""

DECONTAMINATION = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, m, array_to_string(w[k : k + m - 1], ' ') AS t FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT m FROM p),
x AS (SELECT doc_id, m, k, array_to_string(w[k : k + m - 1], ' ') AS t FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, s WHERE len(w) >= m)),
h AS (SELECT doc_id, item_id, m, k FROM x JOIN p USING (m, t)),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n, array_to_string(list(DISTINCT item_id ORDER BY item_id), ',') AS ids FROM h GROUP BY doc_id),
q AS (SELECT doc_id, count(DISTINCT u) AS n FROM (SELECT doc_id, unnest(range(k, k + m)) AS u FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(q.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(q.n, 0) > 0 AS contaminated
FROM d LEFT JOIN i USING (doc_id) LEFT JOIN q USING (doc_id)
"""


NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": LINE_DEDUP, "op6_quality": QUALITY, "op7_decontamination": DECONTAMINATION, "op12_hard_negatives": NEGATIVES}
