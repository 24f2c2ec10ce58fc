"""DuckDB SQL with the same rows as the registered queries that SQL can express."""

from __future__ import annotations

from basketline.llm import secrets

MIXING = r"""WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
  source_size * 2.0::DOUBLE AS cap FROM s),
r AS (SELECT *, ((SELECT sum(source_size) FROM w) * 1.5::DOUBLE
    - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / ((SELECT sum(weight) FROM w)
    - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rate
  FROM w),
t AS (SELECT source, source_size,
  least(cap, coalesce((SELECT arg_min(rate, cap / weight) FROM r WHERE rate * weight <= cap), 'inf'::DOUBLE) * weight) AS target FROM r),
k AS (SELECT d.*, source_size, target, floor(target)::BIGINT AS budget,
  CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs,
  sum(size) OVER (PARTITION BY d.source ORDER BY md5(doc_id::VARCHAR), size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken, source FROM k"""

TOP_K = r"""WITH e AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0)))::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5"""

_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = (("assign", _ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]{24,}", 0, 24),
          ("pem", secrets.MORE[0].pattern.replace("*+)", "*)"), 0, 0), ("forge", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
          ("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0))


def _secrets() -> str:
    """Spans from the gaps that splitting leaves between matches."""
    parts = [f"""SELECT id, {rank} AS rank, '{name}' AS kind, list_transform(range(1, len(m) + 1), lambda i: {{
    'start': list_sum([0] || list_transform(g[1:i], lambda x: length(x)))::BIGINT + list_sum([0] || list_transform(m[1:i-1], lambda x: length(x)))::BIGINT,
    'size': length(m[i])::BIGINT, 'part': length(p[i])}}) AS s FROM (SELECT id, regexp_extract_all(text, '{pattern}', 0) AS m,
    regexp_extract_all(text, '{pattern}', {group}) AS p, string_split_regex(text, '{pattern}') AS g FROM d
    WHERE regexp_matches(text, '{pattern}'))""" for rank, (name, pattern, group, _) in enumerate(_KINDS)]
    least = " ".join(f"WHEN {rank} THEN {least}" for rank, (*_, least) in enumerate(_KINDS))
    return f"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL),
a AS ({' UNION ALL '.join(parts)}),
b AS (SELECT id, rank, kind, unnest(s) AS x FROM a),
c AS (SELECT id, rank, kind, x.start AS start, concat(kind, ':', x.start, ':', x.start + x.size) AS span FROM b
  WHERE x.part >= CASE rank {least} END),
f AS (SELECT id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans FROM c GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN f USING (id)"""


SECRETS = _secrets()

JACCARD = r"""WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT id, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
t AS (SELECT id, len(s) AS n, unnest(s) AS x FROM s),
o AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS n FROM t a JOIN t b ON a.x = b.x AND a.id < b.id
  AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80 GROUP BY a.id, b.id),
e AS (SELECT a, b FROM o WHERE 100 * n >= 80 * (na + nb - n)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(id, reached) AS (SELECT id, id FROM s UNION SELECT r.id, l.b FROM r JOIN l ON r.reached = l.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id FROM s JOIN (
  SELECT r.id, min(d.doc_id) AS component_id FROM r JOIN s d ON r.reached = d.id GROUP BY r.id) c ON s.id = c.id"""

REPEATS = r"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents WHERE doc_id IS NOT NULL),
w AS (SELECT id, i, md5(substr(h, 2 * i - 1, 400)) AS m FROM (SELECT id, h, unnest(range(1, greatest(length(h) // 2 - 198, 1))) AS i FROM d)),
g AS (SELECT id, i, i > lag(i, 1, -1000000) OVER (PARTITION BY id ORDER BY i) + 200 AS new
  FROM (SELECT id, i, count(*) OVER (PARTITION BY m) AS n FROM w) WHERE n > 1),
s AS (SELECT id, min(i) AS lo, max(i) + 199 AS hi
  FROM (SELECT id, i, sum(new::INT) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING) AS span FROM g) GROUP BY id, span),
l AS (SELECT id, list(lo ORDER BY lo) AS lo, list(hi ORDER BY lo) AS hi, count(*) AS n_spans, sum(hi - lo + 1)::BIGINT AS n_removed FROM s GROUP BY id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN lo IS NULL THEN h ELSE array_to_string(list_transform(range(1, len(lo) + 2), lambda k:
    h[CASE WHEN k = 1 THEN 1 ELSE 2 * hi[k - 1] + 1 END:CASE WHEN k > len(lo) THEN length(h) ELSE 2 * lo[k] - 2 END]), '') END)) AS kept_sha256
FROM d LEFT JOIN l USING (id)"""

COLLOCATIONS = r"""WITH p AS (
  SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
x AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM p, (VALUES (1), (2), (3)) AS n(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM x GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
u AS (SELECT c.lang, c.k, c.phrase, a, w, l.f AS l, r.f AS r, cut, (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[cut + 1:], ' ')),
s AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE k = 3)
  GROUP BY ALL),
t AS (SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, s.a DESC, encode(s.phrase)) AS rank
  FROM s LEFT JOIN o ON o.lang = s.lang AND o.phrase = s.phrase WHERE o.a IS NULL OR 100 * o.a < 50 * s.a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM t JOIN n USING (lang) WHERE rank <= 2000"""

_WAYS = """{'w': [
  {'c': a.w[1].c + 3, 'e': a.w[1].e || 'D'},
  list_min([{'c': a.w[2].c + 3, 'e': a.w[2].e || 'D'}, {'c': a.w[1].c + b.s, 'e': a.w[1].e || 'K'}]),
  list_min([{'c': a.w[3].c + 3, 'e': a.w[3].e || 'D'}, {'c': a.w[1].c + b.u, 'e': a.w[1].e || b.x}, {'c': a.w[2].c + b.u, 'e': a.w[2].e || b.x},
    {'c': a.w[4].c + b.u, 'e': a.w[4].e || b.x}, {'c': a.w[3].c + b.u + 2, 'e': a.w[3].e || 'I' || b.x}]),
  list_min([{'c': a.w[4].c + 3, 'e': a.w[4].e || 'D'}, {'c': a.w[3].c + b.a, 'e': a.w[3].e || b.y}, {'c': a.w[1].c + b.a + 2, 'e': a.w[1].e || 'I' || b.y},
    {'c': a.w[2].c + b.a + 2, 'e': a.w[2].e || 'I' || b.y}, {'c': a.w[4].c + b.a + 2, 'e': a.w[4].e || 'I' || b.y}])],
  's': b.s, 'u': b.u, 'a': b.a, 'x': b.x, 'y': b.y}"""

REPAIR = rf"""WITH k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
    lambda x: ascii(x)::BIGINT), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS harm
  FROM conversations),
r AS (SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
  CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE harm WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM k)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM r),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS times, left(role, 1) AS c,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair,
  NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS stop FROM o),
g AS (SELECT *, NOT blank AND times > 1 AS dup, NOT blank AND times = 1 AND stop NOT IN ('.', '!', '?') AS cut FROM f),
l AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank,
  count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
  list({{'w': [{{'c': 0, 'e': ''}}, {{'c': 0, 'e': ''}}, {{'c': 0, 'e': ''}}, {{'c': 0, 'e': ''}}],
    's': CASE WHEN blank OR dup OR c <> 's' THEN 1000000 ELSE cut::INT END, 'u': CASE WHEN blank OR dup THEN 1000000 ELSE cut::INT + 2 * (c <> 'u')::INT END,
    'a': CASE WHEN blank OR dup THEN 1000000 ELSE cut::INT + 2 * (c <> 'a')::INT END,
    'x': CASE WHEN c = 'u' THEN 'K' ELSE 'R' END, 'y': CASE WHEN c = 'a' THEN 'K' ELSE 'R' END}} ORDER BY i) AS rows FROM g GROUP BY conv_id),
v AS (SELECT * EXCLUDE (rows), list_reduce([{{'w': [{{'c': 0, 'e': ''}}, {{'c': 9000000, 'e': ''}}, {{'c': 9000000, 'e': ''}}, {{'c': 9000000, 'e': ''}}],
  's': 0, 'u': 0, 'a': 0, 'x': '', 'y': ''}}] || rows, lambda a, b: {_WAYS}).w AS w FROM l),
b AS (SELECT *, list_min([w[1], {{'c': w[2].c + 4, 'e': w[2].e || 'II'}}, {{'c': w[3].c + 2, 'e': w[3].e || 'I'}}, w[4]]) AS best FROM v),
e AS (SELECT conv_id, n, e, sum((e <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY n) AS i, sum((e <> 'D')::INT) OVER (PARTITION BY conv_id ORDER BY n) AS p
  FROM (SELECT conv_id, unnest(range(1, length(best.e) + 1)) AS n, unnest(string_split(best.e, '')) AS e FROM b WHERE best.e <> '')),
q AS (SELECT e.*, role, text, max((p = 1 AND e = 'K' AND c = 's')::INT) OVER (PARTITION BY e.conv_id) AS lead
  FROM e LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM e.conv_id AND g.i = e.i AND e.e <> 'I' WHERE e.e <> 'D'),
t AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (p - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''),
  chr(10) ORDER BY n) AS text FROM q GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.e, '') AS audit, sha256(coalesce(t.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN b ON a.conv_id IS NOT DISTINCT FROM b.conv_id
LEFT JOIN t ON a.conv_id IS NOT DISTINCT FROM t.conv_id"""
