"""SQL that states an operator's query from its contract, without the operator's method."""

from __future__ import annotations

#: Links by counting shared shingles of every pair that has one, components by following links to a fixed point.
OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
  FROM words
), sizes AS (SELECT doc_id, len(s) AS n FROM sets),
tokens AS (SELECT doc_id, unnest(s) AS token FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM tokens a JOIN tokens b USING (token) WHERE a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, w.b FROM reached r JOIN ways w ON w.a = r.b)
SELECT doc_id, n AS n_shingles, min(b) AS component_id FROM sizes JOIN reached ON a = doc_id GROUP BY doc_id, n
"""
