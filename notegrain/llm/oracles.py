"""The operators' results in DuckDB's SQL, from whole texts and by the definition, not by the method."""

from __future__ import annotations

from . import quality, secrets

_WORDS = r"[^\x20\x09-\x0D]+"

SUBSTRING_DEDUP = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') ws FROM documents),
at AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) i FROM w WHERE len(ws) >= 50),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) k FROM at),
firsts AS (SELECT k, min(doc_id) d FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j p FROM win JOIN firsts USING (k), (SELECT unnest(range(0, 50)) j) WHERE d < doc_id),
words AS (SELECT doc_id, unnest(ws) x, generate_subscripts(ws, 1) p FROM w),
marked AS (SELECT words.doc_id, x, words.p, gone.p IS NOT NULL g FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p),
kept AS (SELECT doc_id, count(*) FILTER (g) n, string_agg(x, ' ' ORDER BY p) FILTER (NOT g) t FROM marked GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) n_words, coalesce(n, 0) n_removed, sha256(coalesce(t, '')) kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
""".replace("at AS", "places AS").replace("FROM at)", "FROM places)")

#: Bytes as pairs of hexadecimal digits, so that every string of 50 is a slice of 100 digits.
SUFFIX_DEDUP = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) h FROM documents),
places AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) i FROM t WHERE length(h) >= 100),
win AS (SELECT doc_id, i, md5_number(substring(h, 2 * i + 1, 100)) k FROM places),
firsts AS (SELECT k, min(doc_id) d FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i FROM win JOIN firsts USING (k) WHERE d < doc_id),
marked AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END new FROM gone),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) run FROM marked),
runs AS (SELECT doc_id, run, min(i) s, max(i) + 50 e FROM numbered GROUP BY 1, 2),
gaps AS (SELECT doc_id, run, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) before FROM runs),
cut AS (SELECT g.doc_id, string_agg(substring(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) kept, max(e) last, sum(e - s) n, count(*) c FROM gaps g JOIN t ON t.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT t.doc_id, CAST(length(h) // 2 AS BIGINT) n_bytes, CAST(coalesce(n, 0) AS BIGINT) n_removed, CAST(coalesce(c, 0) AS BIGINT) n_spans,
  sha256(unhex(CASE WHEN last IS NULL THEN h ELSE kept || substring(h, 2 * last + 1) END)) kept_sha256 FROM t LEFT JOIN cut ON cut.doc_id = t.doc_id
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) n FROM sh GROUP BY 1),
common AS (SELECT a.doc_id x, b.doc_id y, count(*) c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON b.x = r.node),
least AS (SELECT doc_id, min(node) component_id FROM reach GROUP BY 1)
SELECT l.doc_id, coalesce(n, 0) n_shingles, component_id, l.doc_id = component_id kept FROM least l LEFT JOIN n USING (doc_id)
"""

_RULES = " OR ".join(f"({r.rejects})" for r in quality.RULES)
_BASE = " OR ".join(f"({r.rejects})" for r in quality.RULES if r.name in quality.BASE)

QUALITY = rf"""
WITH w AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '{_WORDS}') ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORDS}')) ls FROM documents),
three AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) i FROM w WHERE len(ws) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) c FROM three) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) n FROM twice, (SELECT unnest([0, 1, 2]) j) GROUP BY 1),
m AS (SELECT doc_id, text, CAST(len(ws) AS BIGINT) n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) word_chars,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS BIGINT) n_symbols, CAST(len(ls) AS BIGINT) n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) n_dup_lines, coalesce(covered.n, 0) n_repeat_words,
  length(regexp_replace(coalesce(text, ''), '\P{{L}}', '', 'g')) n_letters, length(regexp_replace(coalesce(text, ''), '\P{{Lu}}', '', 'g')) n_upper
  FROM w LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({_BASE}) base_failed, NOT ({_RULES}) kept FROM m
"""

ORACLES = {"op1_substring_dedup": SUBSTRING_DEDUP, "op2_secret_scan": secrets.oracle_sql(), "op4_suffix_dedup": SUFFIX_DEDUP, "op8_near_duplicates": NEAR_DUPLICATES, "op10_quality_rules": QUALITY}
