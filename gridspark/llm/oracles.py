"""SQL (DuckDB) for the queries of this subpackage that SQL can state."""

from __future__ import annotations

from gridspark.llm import secret_scan as S

#: Every window of 100 bytes as hex text; a byte is gone if one of the hundred windows over it is not the first of its kind.
SUFFIX = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(length(h) // 2)) AS i, h FROM d),
k AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS byte, CASE WHEN 2 * i + 200 <= length(h) THEN substr(h, 2 * i + 1, 200) END AS s FROM w),
f AS (SELECT doc_id, i, byte, s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS later FROM k),
g AS (SELECT doc_id, i, byte, bool_or(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM f),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS opens FROM g),
a AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans,
        sha256(unhex(coalesce(string_agg(byte, '' ORDER BY i) FILTER (WHERE NOT gone), ''))) AS kept_sha256 FROM r GROUP BY 1)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  coalesce(kept_sha256, sha256(unhex(''))) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)
"""


def _quoted(pattern: str) -> str:
    """The pattern as a literal, with the plain word boundary in place of the spelled-out one."""
    return "'" + pattern.replace(S._START, r"\b").replace(S._END, r"\b").replace("'", "''") + "'"


def _secrets(scope: int = 200) -> str:
    kinds = ", ".join(f"('{k}', {i}, {_quoted(p)}, '{S.ROLES[k]}')" for i, (k, p) in enumerate(S.KINDS.items()))
    base = ", ".join(f"'{k}'" for k in S.BASE)
    needs = " OR ".join(f"(kind = '{k}' AND {' AND '.join(roles)})" for k, roles in S.NEEDS.items())
    return f"""
WITH kinds(kind, o, pat, part) AS (VALUES {kinds}),
m AS (SELECT doc_id, kind, o, part, regexp_extract_all(coalesce(text, ''), pat) AS ms, string_split_regex(coalesce(text, ''), pat) AS gs
      FROM documents, kinds WHERE regexp_matches(coalesce(text, ''), pat)),
e AS (SELECT doc_id, kind, o, part, generate_subscripts(ms, 1) AS i, unnest(ms) AS x, unnest(gs[1:len(ms)]) AS g FROM m),
p AS (SELECT *, sum(length(g) + length(x)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS b FROM e),
q AS (SELECT doc_id, kind, o, part, (b - length(x))::BIGINT AS a, b::BIGINT AS b FROM p WHERE CASE
      WHEN kind = 'assign' THEN length(regexp_extract(x, {_quoted(S.ASSIGN)}, 2)) >= {S.ASSIGN_LEAST}
      WHEN kind = 'weak' THEN regexp_matches(x, '[:=]') OR (regexp_matches(x, '[a-z]') AND regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[0-9]')) ELSE TRUE END),
n AS (SELECT w.doc_id, w.kind, w.o, w.a, w.b, bool_or(c.part = 'identifier') AS identifier, bool_or(c.part = 'secret') AS secret,
      bool_or(c.kind IN ({base}) AND c.a < w.b AND w.a < c.b) AS covered
      FROM q w JOIN q c ON w.doc_id = c.doc_id AND c.a <= w.b + {scope} AND c.b >= w.a - {scope} WHERE w.kind NOT IN ({base}) GROUP BY ALL),
s AS (SELECT doc_id, kind, o, a, b FROM q WHERE kind IN ({base}) UNION ALL SELECT doc_id, kind, o, a, b FROM n WHERE NOT covered AND ({needs})),
t AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
      coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o) FILTER (WHERE kind IN ({base})), '') AS base,
      string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o) AS spans FROM s GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans FROM documents LEFT JOIN t USING (doc_id)
"""


SECRETS = _secrets()

#: crc32 of each distinct word byte by byte, over the table that its polynomial makes; gains of buckets; the draw.
RESAMPLING = """
WITH RECURSIVE step(i, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) r(i) UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM step WHERE k = 8),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
u AS (SELECT DISTINCT unnest(ws) AS w FROM (SELECT ws FROM d UNION ALL SELECT ws FROM b)),
bytes AS (SELECT w, [('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT FOR i IN range(octet_length(encode(w)))] AS bs FROM u),
h AS (SELECT w, xor(list_reduce(bs, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS k FROM bytes, tab),
dw AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM d) GROUP BY ALL),
s AS (SELECT k, sum(n) AS n FROM dw JOIN h USING (w) GROUP BY 1),
t AS (SELECT k, count(*) AS n FROM (SELECT unnest(ws) AS w FROM b) JOIN h USING (w) GROUP BY 1),
totals AS (SELECT coalesce((SELECT sum(n) FROM s), 0)::DOUBLE AS big_s, coalesce((SELECT sum(n) FROM t), 0)::DOUBLE AS big_t),
g AS (SELECT h.w, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * (big_s + 10000)) / ((coalesce(s.n, 0) + 1)::DOUBLE * (big_t + 10000))))::BIGINT AS gain
      FROM h, totals LEFT JOIN s ON s.k = h.k LEFT JOIN t ON t.k = h.k),
m AS (SELECT doc_id, sum(n) AS n, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM dw JOIN g USING (w) GROUP BY 1),
f AS (SELECT doc_id, coalesce(m.n, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
      ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS hash FROM d LEFT JOIN m USING (doc_id)),
r AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((hash + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM f),
q AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE n_features >= 20) OVER () AS fit FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * fit // 100 THEN place END AS rank FROM q
"""
