"""Queries and SQL of this subpackage's operators."""

from __future__ import annotations

from . import alignment, bpe, edit_embedding, importance, language, packing, pii, quality_rules, sharding, simhash, substring, toxicity, variants

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_bpe": bpe.op2_bpe,
    "op3_substring": substring.op3_substring,
    "op4_sharding": sharding.op4_sharding,
    "op5_packing": packing.op5_packing,
    "op6_importance": importance.op6_importance,
    "op7_fingerprints": edit_embedding.op7_fingerprints,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_language": language.op9_language,
    "op10_pii": pii.op10_pii,
    "op11_alignment": alignment.op11_alignment,
    "op12_variants": variants.op12_variants,
    "op13_toxicity": toxicity.op13_toxicity,
}
#: All windows of 20 words; those whose words came before cover what goes.
_SUBSTRING = r"""
WITH texts AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), CAST([] AS VARCHAR[])) AS ws FROM documents),
words AS (SELECT doc_id, len(ws) AS n, i, ws[i] AS word, CASE WHEN i + 19 <= len(ws) THEN sha256(array_to_string(ws[i : i + 19], ' ')) END AS wd FROM texts, LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS i)),
again AS (SELECT *, CASE WHEN wd IS NOT NULL AND row_number() OVER (PARTITION BY wd ORDER BY doc_id, i) > 1 THEN 1 ELSE 0 END AS later FROM words),
gone AS (SELECT doc_id, n, i, word, max(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS removed FROM again),
kept AS (SELECT doc_id, CAST(sum(removed) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (removed = 0) AS rest FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM texts LEFT JOIN kept USING (doc_id)
"""
#: Checksums byte by byte from a table that SQL makes, near words by what is left without one letter, chains by recursion.
_VARIANTS = """
WITH RECURSIVE tb AS (SELECT list_transform(range(256), lambda i: list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
per AS (SELECT d, w, count(*) AS n, hex(d || ':' || w) AS x FROM runs GROUP BY d, w),
crc AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS h FROM per, tb),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM crc),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
del AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
pairs AS (SELECT a.word AS a, b.word AS b FROM del a JOIN del b ON a.i = b.i AND a.rest = b.rest AND length(a.word) = length(b.word) AND a.word <> b.word UNION SELECT a.word, b.word FROM del a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word FROM del a JOIN words b ON a.rest = b.word),
best AS (SELECT p.a AS word, count(*) AS n_near, first(p.b ORDER BY w.n DESC, p.b) AS near, max(w.n) AS most FROM pairs p JOIN words w ON w.word = p.b GROUP BY p.a),
forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.most >= 5 * w.n THEN b.near END AS form, CASE WHEN b.most >= 5 * w.n THEN b.most END AS form_n FROM words w LEFT JOIN best b USING (word)),
chain AS (SELECT word, word AS root, 0 AS k FROM forms UNION ALL SELECT c.word, f.form, c.k + 1 FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, k) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""
ORACLE_SQL: dict[str, str] = {"op3_substring": _SUBSTRING, "op12_variants": _VARIANTS}
