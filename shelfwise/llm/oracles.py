"""DuckDB SQL for the training-data queries that SQL can express, over whole tables and whole texts."""

from __future__ import annotations

OP11 = r"""WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (
    SELECT doc_id, list_sort(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END) AS shingles FROM worded),
nodes AS (SELECT shingles, min(doc_id) AS node, len(shingles) AS n FROM sets WHERE len(shingles) > 0 GROUP BY shingles),
postings AS (SELECT node, n, unnest(shingles) AS shingle FROM nodes),
links AS (
    SELECT a.node AS a, b.node AS b FROM postings a JOIN postings b ON a.shingle = b.shingle AND a.node < b.node AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
    GROUP BY a.node, b.node HAVING 100 * count(*) >= 90 * (min(a.n) + min(b.n) - count(*))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT node AS a, node AS b FROM nodes UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
classes AS (SELECT a AS node, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id
FROM sets s LEFT JOIN nodes USING (shingles) LEFT JOIN classes c ON c.node = nodes.node"""

OP13 = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
cut AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS us FROM t),
drawn AS (
    SELECT *, CAST(len(us) AS BIGINT) AS n, CAST('0x' || substr(d, 1, 8) AS BIGINT) % (len(us) + 1) AS p, CAST('0x' || substr(d, 9, 8) AS BIGINT) % (len(us) + 1) AS q,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(d, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
            WHEN CAST('0x' || substr(d, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (
    SELECT *, array_to_string(us[1:least(p, q)], '') AS prefix, array_to_string(us[least(p, q) + 1:greatest(p, q)], '') AS middle, array_to_string(us[greatest(p, q) + 1:], '') AS suffix FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256 FROM parts"""
