"""SQL (DuckDB) for the queries of this subpackage that SQL can express exactly."""

from __future__ import annotations

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATE = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
bw AS (SELECT item_id, w, least(8, len(w)) AS n FROM (SELECT item_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
win AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM bw)),
ns AS (SELECT DISTINCT n FROM win),
hit AS (
  SELECT doc_id, i, d.n, item
  FROM (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw CROSS JOIN ns WHERE len(w) >= n)) d
  JOIN win ON win.n = d.n AND win.s = d.s
),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(h, sha256('')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""

JACCARD = f"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_WORD}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(5, len(w)) - 1), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM dw WHERE len(w) > 0)),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
lk AS (SELECT a, b, c = x.n AND c = y.n AS same FROM common JOIN sz x ON x.doc_id = a JOIN sz y ON y.doc_id = b WHERE c >= 8e-1 * (x.n + y.n - c) - 1e-9),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, lk.b FROM reach JOIN lk ON lk.a = reach.b),
cls AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a),
cnt AS (SELECT a, count(*) AS n_links, count(*) FILTER (NOT same) AS n_text FROM lk GROUP BY a),
cp AS (SELECT a, b FROM lk WHERE same),
txt AS (SELECT lk.a, count(DISTINCT coalesce(k.m, lk.b)) AS n_text_links FROM lk LEFT JOIN (SELECT a, least(a, min(b)) AS m FROM cp GROUP BY a) k ON k.a = lk.b WHERE NOT same GROUP BY lk.a)
SELECT d.doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(n_text_links, 0) AS n_text_links, coalesce(sz.n, 0) AS n_shingles
FROM documents d JOIN cls ON cls.a = d.doc_id LEFT JOIN cnt ON cnt.a = d.doc_id LEFT JOIN txt ON txt.a = d.doc_id LEFT JOIN sz ON sz.doc_id = d.doc_id
"""
