"""DuckDB SQL for the queries of the text operators that SQL can express."""

from __future__ import annotations

from axisflow.llm.quality import CLASSES, COMMON_WORDS, SYMBOLS

OP2 = """
WITH p AS (
  SELECT page_id, sha256(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages
), f AS (
  SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS first FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""

OP6 = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, row_number() OVER () AS k,
    translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r(rule_host, rule_path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), m AS (
  SELECT k, rule_host || rule_path AS rule, verdict,
    row_number() OVER (PARTITION BY k ORDER BY length(rule_host || rule_path) DESC) AS place
  FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON m.k = p.k AND m.place = 1
"""

_WORDS = r"list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP4 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark
), ds AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)
), bs AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b)
), n AS (
  SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id
)
SELECT doc_id, item_id, count(*) AS n_shared, n_item, count(*) / n_item AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item
HAVING count(*) >= ceil(0.8 * n_item - 1e-9)
"""


def _gone(pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"length(t) - length(regexp_replace(t, '{quoted}', '', 'g'))"


def _distance(p: str, q: str) -> str:
    share = lambda a: f"list_transform({a}, lambda x: x / list_sum({a}))"
    term = "CASE WHEN {0} > 0 THEN {0} * log2({0} / ((z[1] + z[2]) / 2)) ELSE 0 END"
    terms = f"list_transform(list_zip({share(p)}, {share(q)}), lambda z: {term.format('z[1]')} + {term.format('z[2]')})"
    return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(list_sum({terms}) / 2, 0)) ELSE 0 END"


def op5() -> str:
    """Base counts, histograms, references by language, and the verdict with the production thresholds."""
    classes = [_gone(p) for p in (*CLASSES, SYMBOLS)]
    common = [f"len(list_filter(w, lambda x: x = '{c}'))" for c in COMMON_WORDS]
    sums = lambda c, k, when: "[" + ", ".join(f"sum(CASE WHEN {when} THEN {c}[{i + 1}] ELSE 0 END)" for i in range(k)) + "]"
    return f"""
WITH p AS (
  SELECT row_number() OVER () AS k, doc_id, lang, coalesce(text, '') AS t, {_WORDS.replace('(t,', "(coalesce(text, ''),")} AS w FROM documents
), g AS (
  SELECT k, i, count(*) OVER (PARTITION BY k, x) AS times FROM (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM p))
), r AS (
  SELECT k, count(DISTINCT j) AS n_repeat_words FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM g WHERE times > 1) GROUP BY k
), f AS (
  SELECT k, doc_id, lang, length(t) AS n_chars, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, {_gone(SYMBOLS)} AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
    [{', '.join(classes)}, length(t) - length(array_to_string(w, ''))] AS c0, [{', '.join(common)}] AS m0
  FROM p
), h AS (
  SELECT * REPLACE (coalesce(n_repeat_words, 0) AS n_repeat_words), n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed,
    list_append(c0, n_chars - list_sum(c0)) AS c, list_append(m0, n_words - list_sum(m0)) AS m FROM f LEFT JOIN r USING (k)
), u0 AS (
  SELECT lang, {sums('c', len(CLASSES) + 3, 'NOT base_failed')} AS rc FROM h GROUP BY lang
), t AS (
  SELECT h.*, NOT base_failed AND {_distance('c', 'rc')} <= 0.28 AS typical FROM h JOIN u0 ON h.lang IS NOT DISTINCT FROM u0.lang
), u AS (
  SELECT lang, {sums('c', len(CLASSES) + 3, 'typical')} AS rc, {sums('m', len(COMMON_WORDS) + 1, 'typical')} AS rm FROM t GROUP BY lang
), v AS (
  SELECT t.*, {_distance('c', 'rc')} AS cd, {_distance('m', 'rm')} AS wd
  FROM t JOIN u ON t.lang IS NOT DISTINCT FROM u.lang
)
SELECT doc_id, n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words,
  base_failed,
  NOT (base_failed OR n_chars >= 200 AND cd > 0.28 OR n_chars >= 200 AND n_words >= 50 AND wd > 0.24 AND cd > 0.125) AS kept
FROM v
"""
