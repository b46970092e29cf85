"""DuckDB SQL over whole tables for the operators that it can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

OP1 = """WITH s AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
v AS (SELECT doc_id, i, hash(substring(x, 2 * i + 1, 400)) AS h FROM (SELECT doc_id, x, unnest(range(greatest(len(x) // 2 - 199, 0))) AS i FROM s)),
r AS (SELECT h FROM v GROUP BY h HAVING count(*) > 1),
w AS (SELECT v.doc_id, v.i FROM v JOIN r USING (h)),
b AS (SELECT doc_id, i, substring(x, 2 * i + 1, 2) AS byte FROM (SELECT doc_id, x, unnest(range(len(x) // 2)) AS i FROM s)),
f AS (SELECT b.*, max(CASE WHEN w.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY b.doc_id ORDER BY b.i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS gone FROM b LEFT JOIN w ON w.doc_id = b.doc_id AND w.i = b.i),
g AS (SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) AS before FROM f),
o AS (SELECT doc_id, count(*) AS n_bytes, sum(gone) AS n_removed, count(*) FILTER (gone = 1 AND before = 0) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (gone = 0) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM documents d LEFT JOIN o USING (doc_id)"""

OP2 = f"""WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
l AS (SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS i FROM s),
k AS (SELECT *, translate(trim(line, {SPACE}), '{UPPER}', '{LOWER}') AS key FROM l),
h AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
d AS (SELECT k.doc_id, k.i, k.line, coalesce(k.doc_id <> h.top, false) AS gone FROM k LEFT JOIN h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM d GROUP BY doc_id"""

OP6 = f"""WITH s AS (SELECT doc_id, {WORDS} AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM s),
v AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 35], ' ') AS t FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 34, 0))) AS i FROM s)),
r AS (SELECT t FROM v GROUP BY t HAVING count(*) > 1),
f AS (SELECT x.doc_id, x.i, x.word, CASE WHEN r.t IS NULL THEN 0 ELSE 1 END AS hit FROM x LEFT JOIN v ON v.doc_id = x.doc_id AND v.i = x.i LEFT JOIN r ON r.t = v.t),
g AS (SELECT *, max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM f),
o AS (SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN o USING (doc_id)"""

OP3 = f"""WITH RECURSIVE s AS (SELECT doc_id, {WORDS.replace("coalesce(text, '')", f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS w FROM documents),
t AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 3, 1))) AS i FROM s WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
c(doc_id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT c.doc_id, e.b FROM c JOIN e ON e.a = c.m)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(c.m) AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id) GROUP BY 1, 2"""

OP13 = """WITH s AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS x, [CAST('0x' || substring(h, 8 * k + 1, 8) AS BIGINT) for k in range(4)] AS r FROM s),
c AS (SELECT *, len(x) AS n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS lo, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS hi FROM c),
q AS (SELECT *, array_to_string(x[1 : lo], '') AS a, array_to_string(x[lo + 1 : hi], '') AS b, array_to_string(x[hi + 1 : n], '') AS z FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(t) AS restored_sha256 FROM q"""

#: The base of op10: what its contract fixes, without the learned list's verdict.
OP10_BASE = f"""WITH s AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM s), d AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
v AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 0))) AS i FROM s)),
r AS (SELECT doc_id, g FROM v GROUP BY 1, 2 HAVING count(*) > 1), c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT v.doc_id, unnest(range(v.i, v.i + 5)) AS p FROM v JOIN r USING (doc_id, g)) GROUP BY 1),
b AS (SELECT s.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(d.dup, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM s LEFT JOIN d USING (doc_id) LEFT JOIN c USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b"""
