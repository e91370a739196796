"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from logloom.llm import bpe, chat, fingerprints, infilling, jaccard, line_templates, neighbours, packing, pii, quality, repair, repeats, winnowing

QUERIES = {
    "op1_document_fingerprints": fingerprints.op1_document_fingerprints,
    "op2_packing": packing.op2_packing,
    "op3_ngram_jaccard": jaccard.op3_ngram_jaccard,
    "op4_quality_classifier": quality.op4_quality_classifier,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_pii": pii.op6_pii,
    "op7_substring_dedup": repeats.op7_substring_dedup,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_nearest_neighbours": neighbours.op9_nearest_neighbours,
    "op10_line_dedup": line_templates.op10_line_dedup,
    "op11_decontamination": winnowing.op11_decontamination,
    "op12_fill_in_middle": infilling.op12_fill_in_middle,
    "op13_structure_repair": repair.op13_structure_repair,
}

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

OP3_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' ')) END) AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b
  WHERE 100 * both_have >= 85 * (len(x.sh) + len(y.sh) - both_have)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM s UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node)
SELECT s.doc_id, CAST(len(any_value(s.sh)) AS BIGINT) AS n_shingles, min(r.root) AS component_id
FROM s JOIN r ON r.node = s.doc_id GROUP BY s.doc_id
"""

OP7_SQL = rf"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
v AS (SELECT doc_id, i AS st, array_to_string(ws[i : i + 19], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
f AS (SELECT doc_id, st, row_number() OVER (PARTITION BY g ORDER BY doc_id, st) AS k FROM v),
x AS (SELECT DISTINCT doc_id, unnest(range(st, st + 20)) AS i FROM f WHERE k > 1),
o AS (SELECT w.doc_id, i, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) w),
k AS (SELECT o.doc_id, string_agg(word, ' ' ORDER BY o.i) AS kept, count(*) AS n FROM o ANTI JOIN x ON o.doc_id = x.doc_id AND o.i = x.i GROUP BY o.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""

SQL = {
    "op3_ngram_jaccard": OP3_SQL,
    "op7_substring_dedup": OP7_SQL,
    "op8_chat_formatting": chat.OP8_SQL,
    "op11_decontamination": winnowing.OP11_SQL,
    "op12_fill_in_middle": infilling.OP12_SQL,
    "op13_structure_repair": repair.OP13_SQL,
}
