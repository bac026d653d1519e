"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .quality import RULES, STOP_WORDS

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _quality() -> str:
    stops = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws.split()}))
    ratio = {
        "n_words": "n", "repeat_ratio": "(CASE WHEN n > 0 THEN n_repeat / n ELSE 0 END)", "mean_word_length": "(CASE WHEN n > 0 THEN chars / n ELSE 0 END)",
        "symbol_ratio": "(CASE WHEN n > 0 THEN symbols / n ELSE 0 END)", "stop_ratio": "(CASE WHEN n > 0 THEN stop / n ELSE 0 END)",
        "dup_line_ratio": "(CASE WHEN len(lines) > 0 THEN n_dup / len(lines) ELSE 0 END)", "bullet_ratio": "(CASE WHEN len(lines) > 0 THEN bullets / len(lines) ELSE 0 END)",
        "ellipsis_ratio": "(CASE WHEN len(lines) > 0 THEN ellipses / len(lines) ELSE 0 END)",
    }
    tests = [f"{ratio[r.measure]} >= {r.least}" for r in RULES if r.least != float("-inf")] + [f"{ratio[r.measure]} <= {r.most}" for r in RULES if r.most != float("inf")]
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
tri AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 2)) AS i, w FROM d WHERE len(w) >= 3),
tri2 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM tri),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM tri2 WHERE c > 1) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, lines, len(w)::DOUBLE AS n, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::DOUBLE AS chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::DOUBLE AS symbols,
    (len(lines) - len(list_distinct(lines)))::DOUBLE AS n_dup, coalesce(n_repeat, 0)::DOUBLE AS n_repeat,
    len(list_filter(w, lambda x: trim(lower(x), '.,;:!?') IN ({stops})))::DOUBLE AS stop,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*•]')))::DOUBLE AS bullets,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$')))::DOUBLE AS ellipses
  FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id)
SELECT doc_id, n::BIGINT AS n_words, chars::BIGINT AS word_chars, symbols::BIGINT AS n_symbols, n_dup::BIGINT AS n_dup_lines, n_repeat::BIGINT AS n_repeat_words,
  (n < 50 OR 100 * n_repeat > 50 * n) AS base_failed,
  (NOT (n < 50 OR 100 * n_repeat > 50 * n) AND {' AND '.join(tests)}) AS kept
FROM m"""


LINE_DEDUP = r"""
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
f AS (SELECT k, min(doc_id) AS keep FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
x AS (SELECT l.doc_id, i, line, (f.k IS NOT NULL AND l.doc_id <> keep) AS gone FROM l LEFT JOIN f ON l.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM x GROUP BY doc_id"""

ORACLES = {
    "op4_quality_rules": _quality(),
    "op6_line_dedup": LINE_DEDUP,
}
