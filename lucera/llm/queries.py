"""The subpackage's queries and their SQL, as the entry module registers them."""

from __future__ import annotations

from lucera.llm import bpe, fingerprints, html_extraction, jaccard_join, mixing, quality_classifier, quality_rules, substring_dedup, token_files, warc_zip

QUERIES = {
    "op1_quality_classifier": quality_classifier.op1_quality_classifier,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_document_fingerprints": fingerprints.op3_document_fingerprints,
    "op4_mixing": mixing.op4_mixing,
    "op5_html_extraction": html_extraction.op5_html_extraction,
    "op6_token_files": token_files.op6_token_files,
    "op7_bpe": bpe.op7_bpe,
    "op8_ngram_jaccard_join": jaccard_join.op8_ngram_jaccard_join,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_warc_zip": warc_zip.op10_warc_zip,
}

#: Operator 9 by brute force: every window against every document of smaller id (null is least).
SUBSTRING_SQL = r"""WITH
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, -9223372036854775808) AS d0, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT rid, d0, i, md5(array_to_string(ws[i:i+49], ' ')) AS k FROM (SELECT rid, d0, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
f AS (SELECT k, min(d0) AS first FROM w GROUP BY k HAVING count(*) > 1),
r AS (SELECT rid, i FROM w JOIN f ON w.k = f.k AND w.d0 > f.first),
g AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS p FROM r),
x AS (SELECT rid, count(*) AS n FROM g GROUP BY rid),
e AS (SELECT rid, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM d WHERE rid IN (SELECT rid FROM x)),
t AS (SELECT e.rid, string_agg(word, ' ' ORDER BY e.p) AS kept FROM e ANTI JOIN g ON e.rid = g.rid AND e.p = g.p GROUP BY e.rid)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN n IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM d LEFT JOIN x ON d.rid = x.rid LEFT JOIN t ON d.rid = t.rid"""

ORACLE_SQL = {
    "op2_quality_rules": quality_rules.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op9_substring_dedup": SUBSTRING_SQL,
    "op10_warc_zip": warc_zip.ORACLE,
}
