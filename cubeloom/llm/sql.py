"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

# Rules and constants are spelled out here once more, so that a wrong one in an operator shows.
_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: (kind, expression, group that is measured, least length); the first three are the base kinds.
_SECRETS = (
    ("assign", "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("github", "gh[pousr]_[A-Za-z0-9]{36}", 0, 1),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("pem", "-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", 0, 1),
    ("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("google", "AIza[0-9A-Za-z_-]{35}", 0, 1),
)
_PHRASES = "(?i)all rights reserved|accept cookies|cookie policy|enable javascript|privacy policy|terms of service|terms of use|click here to|sign up for our newsletter|share on facebook|back to top"
_END_MARK = "[.!?…。！？।॥؟۔,;:，：；、،-][\\p{Pe}\\p{Pf}\\p{Pi}\"'*_ \\t\\n\\x0b\\f\\r]*$"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _url_sql() -> str:
    rows = ", ".join(f"({_quote(h)}, {_quote(p)}, {_quote(v)})" for h, p, v in _RULES)
    return f"""
WITH base AS (
  SELECT row_number() OVER () AS r, page_id,
    CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT r, page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM base),
rules(rh, rp, rv) AS (VALUES {rows}),
best AS (
  SELECT r, arg_max(rh || rp, (length(rh) + length(rp)) * 100000 + length(rh)) AS rule,
         arg_max(rv, (length(rh) + length(rp)) * 100000 + length(rh)) AS verdict
  FROM split JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM split LEFT JOIN best USING (r)"""


def _secret_sql() -> str:
    parts = []
    for rank, (kind, expression, group, least) in enumerate(_SECRETS):
        pattern = _quote(f"(?s)(.*?)({expression})")
        value = 2 + group
        parts.append(f"""
  SELECT r, {rank} AS rank, {_quote(kind)} AS kind, b AS start_at, b + length(h) AS end_at FROM (
    SELECT r, h, v, sum(length(g) + length(h)) OVER (PARTITION BY r ORDER BY i) - length(h) AS b FROM (
      SELECT r, unnest(range(len(gs))) AS i, unnest(gs) AS g, unnest(hs) AS h, unnest(vs) AS v FROM (
        SELECT r, regexp_extract_all(t, {pattern}, 1) AS gs, regexp_extract_all(t, {pattern}, 2) AS hs, regexp_extract_all(t, {pattern}, {value}) AS vs
        FROM docs WHERE regexp_matches(t, {_quote(expression)}))))
  WHERE length(v) >= {least}""")
    one = "kind || ':' || CAST(start_at AS BIGINT) || ':' || CAST(end_at AS BIGINT)"
    n, kinds = 3, [k for k, *_ in _SECRETS[:3]]
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(parts)}),
per AS (
  SELECT r, {", ".join(f"count(*) FILTER (WHERE kind = {_quote(k)}) AS n_{k}" for k in kinds)},
    coalesce(string_agg({one}, ',' ORDER BY start_at, rank) FILTER (WHERE rank < {n}), '') AS base,
    string_agg({one}, ',' ORDER BY start_at, rank) AS spans
  FROM spans GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in kinds)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN per USING (r)"""


def quality_relation(table: str) -> str:
    """The quality rules over a table: all its columns, the counts, the cleaned text and the verdict."""
    word, space = "[^ \\t\\n\\x0b\\f\\r]+", "[ \\t\\n\\x0b\\f\\r]+"
    count = lambda pattern: f"len(regexp_extract_all(l, {_quote(pattern)}))"
    phrase, end = _quote(_PHRASES), _quote(_END_MARK)
    n_words, n_marks, n_solid, n_upper, n_cased = count(word), count("[\\p{P}\\p{S}]"), count("[^ \\t\\n\\x0b\\f\\r]"), count("\\p{Lu}"), count("[\\p{Lu}\\p{Ll}]")
    nav = f"{count('[|»›•]')} >= greatest(3, {n_words} / 4.0)"
    junk = f"{count('(?:[#*$%&<>|~^]{2,}|[A-Z]{2,}[,.]?!!)')} * 2 > {n_words}"
    legal = f"(regexp_matches(l, {phrase}) AND (({n_words} <= 20 AND length(l) <= 200) OR length(l) - length(regexp_replace(l, {phrase}, '', 'g')) >= length(l) * 0.25::DOUBLE))"
    marks = f"({n_marks} * 2 > {n_solid} OR ({n_marks} >= 8 AND {n_marks} > {n_solid} * 0.3::DOUBLE))"
    shout = f"({n_cased} >= CASE WHEN regexp_matches(l, '[!！]') THEN 8 ELSE 20 END AND {n_upper} > {n_cased} * 0.7::DOUBLE)"
    bad = f"({nav} OR {junk} OR {legal} OR {marks} OR {shout})"
    stub = f"CASE WHEN regexp_matches(l, '{word}') THEN {n_words} < 6 AND length(l) < 60 AND NOT regexp_matches(l, {end}) END"
    near = lambda sign: f"coalesce({', '.join(f'CASE WHEN i {sign} {k} > 0 THEN stubs[i {sign} {k}] END' for k in (1, 2, 3))}, false)"
    menu = f"(stubs[i] AND ({near('-')} OR {near('+')}))"
    k = 8
    return f"""(
WITH base AS (SELECT row_number() OVER () AS r, *, coalesce(text, '') AS t FROM {table}),
split AS (
  SELECT *, regexp_extract_all(t, '{word}') AS ws, string_split(t, chr(10)) AS ls FROM base),
parts AS (SELECT *, list_transform(ls, lambda l: {stub}) AS stubs FROM split),
lines AS (
  SELECT *, list_filter(ls, lambda l: regexp_matches(l, '{word}')) AS full_ls, list_filter(ls, lambda l, i: NOT regexp_matches(l, '{word}') OR NOT ({bad} OR {menu})) AS kept_ls FROM parts),
wins AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w) AS c FROM (
    SELECT r, unnest(range(1, len(ws) - {k - 2})) AS i, unnest(list_transform(range(1, len(ws) - {k - 2}), lambda i: list_slice(ws, i, i + {k - 1}))) AS w FROM parts WHERE len(ws) >= {k})),
cover AS (
  SELECT r, sum(least({k}, coalesce(nxt - i, {k}))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM wins WHERE c > 1) GROUP BY r),
counted AS (
  SELECT lines.*, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(full_ls) - len(list_distinct(full_ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    CASE WHEN len(kept_ls) = len(ls) THEN t ELSE array_to_string(kept_ls, chr(10)) END AS clean
  FROM lines LEFT JOIN cover USING (r)),
judged AS (
  SELECT *, CASE WHEN len(kept_ls) = len(ls) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - length(regexp_replace(clean, '{space}', '', 'g')) / greatest(word_chars, 1)::DOUBLE END AS lost,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
  FROM counted)
SELECT *, NOT base_failed AND lost <= 0.5 AS kept FROM judged)"""


def _quality_sql() -> str:
    return f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost, kept FROM {quality_relation('documents')}"


_WORD = "[^ \\t\\n\\x0b\\f\\r]+"


def _near_sql() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    k = 5
    return f"""
WITH RECURSIVE base AS (SELECT doc_id, regexp_extract_all({lower}, '{_WORD}') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= {k} THEN list_transform(range(1, len(ws) - {k - 2}), lambda i: array_to_string(list_slice(ws, i, i + {k - 1}), ' ')) ELSE [array_to_string(ws, ' ')] END) AS s
  FROM base WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM base UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT base.doc_id, coalesce(n, 0) AS n_shingles, component_id, base.doc_id = component_id AS kept
FROM base LEFT JOIN n ON n.doc_id = base.doc_id JOIN comp ON comp.a = base.doc_id"""


def _words_sql() -> str:
    k = 35
    return f"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
pos AS (
  SELECT r, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w,
    unnest(list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN i + {k - 1} <= len(ws) THEN array_to_string(list_slice(ws, i, i + {k - 1}), ' ') END)) AS win
  FROM base),
rep AS (SELECT r, i, w, win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 AS rep FROM pos),
cov AS (SELECT r, i, w, coalesce(i - max(CASE WHEN rep THEN i END) OVER (PARTITION BY r ORDER BY i) < {k}, false) AS gone FROM rep),
per AS (SELECT r, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM cov GROUP BY r)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM base LEFT JOIN per USING (r)"""


def _bytes_sql() -> str:
    k = 50
    return f"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, hex(coalesce(text, '')) AS h FROM documents),
pos AS (SELECT r, doc_id, unnest(range(0, length(h) // 2)) AS i, h FROM base),
win AS (SELECT r, doc_id, i, substr(h, 2 * i + 1, 2) AS b, CASE WHEN 2 * (i + {k}) <= length(h) THEN substr(h, 2 * i + 1, {2 * k}) END AS w FROM pos),
rep AS (SELECT r, i, b, w IS NOT NULL AND min(doc_id) OVER (PARTITION BY w) < doc_id AS rep FROM win),
cov AS (SELECT r, i, b, coalesce(i - max(CASE WHEN rep THEN i END) OVER (PARTITION BY r ORDER BY i) < {k}, false) AS gone FROM rep),
run AS (SELECT r, i, b, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS starts FROM cov),
per AS (SELECT r, count(*) AS n_bytes, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE starts) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM run GROUP BY r)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM base LEFT JOIN per USING (r)"""


ORACLES = {
    "op1_url_filter": _url_sql(),
    "op2_secret_scan": _secret_sql(),
    "op3_minhash_dedup": _near_sql(),
    "op4_substring_dedup": _words_sql(),
    "op9_suffix_dedup": _bytes_sql(),
    "op10_quality_rules": _quality_sql(),
}
