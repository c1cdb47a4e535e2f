"""DuckDB SQL for those corpus queries that SQL can express."""

from __future__ import annotations

_A_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

DECONTAMINATION = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), {_A_Z}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), {_A_Z}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
s AS (SELECT item, w, least(len(w), 10) AS k, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS a FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(w[a + 1 : a + k], ' ') AS t FROM s),
ks AS (SELECT DISTINCT k FROM win),
p AS (SELECT r, w, unnest(range(0, len(w))) AS a FROM d),
h AS (
  SELECT r, a, p2.k, item FROM
    (SELECT r, a, k, array_to_string(w[a + 1 : a + k], ' ') AS t FROM p JOIN ks ON a + k <= len(w)) p2
    JOIN win ON win.k = p2.k AND win.t = p2.t),
pos AS (SELECT DISTINCT r, x FROM (SELECT r, unnest(range(a, a + k)) AS x FROM h)),
n AS (SELECT r, count(*) AS n_hit FROM pos GROUP BY r),
g AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS t FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN g USING (r)
"""

_LEVEL = """
{name}_s AS (SELECT coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad, count(*)::DOUBLE AS g,
  coalesce(sum(n * n), 0)::DOUBLE AS nn, coalesce(sum(bad::DOUBLE * bad / n), 0)::DOUBLE AS q FROM {table}),
{name}_r AS (SELECT *, (bad + 0.5::DOUBLE) / (n + 1.0::DOUBLE) AS rate, n - nn / nullif(n, 0) - (g - 1) AS room FROM {name}_s),
{name}_k AS (SELECT rate, CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE (1 - rho) / rho END AS k FROM (
  SELECT *, CASE WHEN room > 0 THEN least(greatest((q - 2 * rate * bad + rate * rate * n - rate * (1 - rate) * (g - 1)) / (rate * (1 - rate) * room), 0.01::DOUBLE), 0.99::DOUBLE) ELSE 0.01::DOUBLE END AS rho FROM {name}_r))"""

_SITE = r"regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.+$', '')"
_ADDRESS = r"^(?:[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+|\[.*)$"
#: Bisection on the regularised incomplete beta function, whose continued fraction is folded over a list; the state is [c, d, h].
_HALVE = """
  SELECT site, n_labelled, mean, w, a, b, lb, CASE WHEN f < 0.05 THEN mid ELSE lo END, CASE WHEN f < 0.05 THEN hi ELSE mid END, i + 1 FROM (
    SELECT *, CASE WHEN far THEN 1 - g ELSE g END AS f FROM (
      SELECT *, exp(p * ln(x) + q * ln(1 - x) - lb) / p * list_reduce(list_transform(range(1, 201), lambda m: [m::DOUBLE, 0, 0]), lambda s, m: {odd}, [1.0::DOUBLE, 1 / (1 - (p + q) * x / (p + 1)), 1 / (1 - (p + q) * x / (p + 1))])[3] AS g FROM (
        SELECT *, mid > (a + 1) / (a + b + 2) AS far, CASE WHEN mid > (a + 1) / (a + b + 2) THEN 1 - mid ELSE mid END AS x, CASE WHEN mid > (a + 1) / (a + b + 2) THEN b ELSE a END AS p, CASE WHEN mid > (a + 1) / (a + b + 2) THEN a ELSE b END AS q FROM (
          SELECT *, (lo + hi) / 2 AS mid FROM bis WHERE i < 30))))"""


def _lentz(state: str, term: str) -> str:
    """One step of the fraction: c, d, and h times both."""
    c, d = f"(1 + {term} / {state}[1])", f"(1 / (1 + {term} * {state}[2]))"
    return f"[{c}, {d}, {state}[3] * {c} * {d}]"


_EVEN = "(m[1] * (q - m[1]) * x / ((p - 1 + 2 * m[1]) * (p + 2 * m[1])))"
_ODD = "(-(p + m[1]) * (p + q + m[1]) * x / ((p + 2 * m[1]) * (p + 1 + 2 * m[1])))"
_BISECT = _HALVE.format(odd=_lentz(_lentz("s", _EVEN), _ODD))

_DOMAIN = rf"CASE WHEN regexp_matches(site, '{_ADDRESS}') THEN site ELSE " + r"coalesce(nullif(regexp_extract(site, '([^.]+\.(?:ac\.uk|co\.jp|co\.uk|com\.au|com\.br|gov\.uk|org\.uk|[^.]+))$', 1), ''), site) END"

HOST_REPUTATION = (
    rf"""
WITH RECURSIVE p00 AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), {_A_Z}) AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
p0 AS (SELECT *, {_SITE} AS site FROM p00),
p AS (SELECT *, {_DOMAIN} AS domain FROM p0),
q AS (SELECT *, CASE WHEN regexp_matches(domain, '{_ADDRESS}') THEN '' ELSE regexp_extract(domain, '^[^.]*\.(.*)$', 1) END AS suffix FROM p),
m AS (SELECT doc_id AS page_id, count(*) AS n, count(*) FILTER (coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0) AS bad FROM labels GROUP BY 1),
h AS (SELECT site, domain, suffix, sum(n) AS n, sum(bad) AS bad FROM q JOIN m USING (page_id) GROUP BY ALL),
dm AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
sf AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM dm GROUP BY ALL),"""
    + _LEVEL.format(name="ks", table="sf") + "," + _LEVEL.format(name="kd", table="dm") + "," + _LEVEL.format(name="kh", table="h")
    + """,
sm AS (SELECT suffix, (bad + k * rate) / (n + k) AS suffix_mean FROM sf, ks_k),
dd AS (SELECT domain, (bad + k * suffix_mean) / (n + k) AS domain_mean FROM dm JOIN sm USING (suffix), kd_k),
e AS (SELECT DISTINCT site, domain, suffix FROM q),
t AS (
  SELECT site, coalesce(n, 0) AS n_labelled, (coalesce(bad, 0) + kh_k.k * coalesce(domain_mean, suffix_mean, ks_k.rate)) / (coalesce(n, 0) + kh_k.k) AS mean, coalesce(n, 0) + kh_k.k AS w
  FROM e LEFT JOIN (SELECT site, n, bad FROM h) USING (site) LEFT JOIN dd USING (domain) LEFT JOIN sm USING (suffix), kh_k, ks_k),
t2 AS (SELECT *, mean * w AS a, (1 - mean) * w AS b, lgamma(mean * w) + lgamma((1 - mean) * w) - lgamma(w) AS lb FROM t),
bis AS (SELECT site, n_labelled, mean, w, a, b, lb, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS i FROM t2 UNION ALL """
    + _BISECT
    + r"""),
v AS (SELECT site, n_labelled, round(mean, 6) AS bad_mean, round(greatest(CASE WHEN w > 10000 THEN mean - 1.6448536269514722::DOUBLE * sqrt(mean * (1 - mean) / (w + 1)) ELSE (lo + hi) / 2 END, 0.0::DOUBLE), 6) AS bad_low FROM bis WHERE i = 30),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM q)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN bad_low > 0.5 THEN 'block' ELSE 'allow' END AS verdict,
  CAST(n_labelled AS BIGINT) AS n_labelled, bad_mean, bad_low
FROM r JOIN v USING (site)
"""
)

#: Sets that share a shingle, compared in full; classes and components by reachability.
JACCARD = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_A_Z}), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM d),
k AS (SELECT list_sort(s) AS s, min(doc_id) AS class_id, len(any_value(s)) AS n FROM g WHERE len(s) > 0 GROUP BY list_sort(s)),
c AS (SELECT row_number() OVER (ORDER BY class_id) AS c, * FROM k),
x AS (SELECT c, n, unnest(s) AS t FROM c),
pair AS (
  SELECT a.c AS a, b.c AS b FROM x a JOIN x b ON a.t = b.t AND a.c < b.c AND b.n * 100 >= a.n * 90 AND a.n * 100 >= b.n * 90
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
reach(c, x) AS (SELECT c, c FROM c UNION SELECT reach.c, e.b FROM reach JOIN e ON e.a = reach.x),
m AS (SELECT reach.c, min(c.class_id) AS component_id FROM reach JOIN c ON c.c = reach.x GROUP BY 1)
SELECT doc_id, CAST(len(g.s) AS BIGINT) AS n_shingles, coalesce(c.class_id, doc_id) AS class_id, coalesce(component_id, doc_id) AS component_id
FROM g LEFT JOIN c ON list_sort(g.s) = c.s LEFT JOIN m USING (c)
"""

#: All 50-byte strings by place; runs of removed bytes, and what lies between them.
SUFFIX = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, p, b[p:p + 49] AS s FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 48)) AS p FROM d)),
h AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS least FROM w) WHERE least < doc_id),
i AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER o + 50 THEN 0 ELSE 1 END AS new FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
r AS (SELECT doc_id, min(p) AS a, max(p) + 49 AS z FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM i) GROUP BY doc_id, g),
k AS (SELECT doc_id, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z, sum(z - a + 1) AS n, count(*) AS spans FROM r GROUP BY 1)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN n IS NULL THEN b ELSE list_reduce(list_transform(range(1, len(a) + 2), lambda j: b[CASE WHEN j = 1 THEN 1 ELSE z[j - 1] + 1 END : CASE WHEN j > len(a) THEN octet_length(b) ELSE a[j] - 1 END]), lambda x, y: x || y) END) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

_NEAREST = """
d{i} AS MATERIALIZED (SELECT p.r, p.part, b.e, list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM p JOIN b{i} b USING (part)),
a{i} AS MATERIALIZED (SELECT r, part, min_by(e, d * 256 + e) AS e, min(d) AS d FROM d{i} GROUP BY r, part)"""
_REFINE = """
s{i} AS (SELECT part, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY pos) AS c FROM (
  SELECT part, e, pos, sum(x[pos])::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT a.part, a.e, p.x, unnest(range(1, len(p.x) + 1)) AS pos FROM a{i} a JOIN p USING (r, part)) GROUP BY ALL) GROUP BY part, e),
b{j} AS MATERIALIZED (SELECT part, e, coalesce(s.c, b.c) AS c FROM b{i} b LEFT JOIN s{i} s USING (part, e))"""
VECTOR_CODES = (
    """
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] AS x FROM k, range(4) t(part)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS e, x AS c FROM p WHERE r <= 256),"""
    + ",".join(_NEAREST.format(i=i) + ("," + _REFINE.format(i=i, j=i + 1) if i < 4 else "") for i in range(5))
    + """,
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS h FROM b4),
o AS (SELECT r, string_agg(format('{:02x}', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM k JOIN o USING (r), h
"""
)

COLLOCATIONS = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), {_A_Z}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i : i + k - 1])) AS p FROM w, range(1, 4) t(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, p, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, k, p, f AS a FROM f WHERE k > 1),
cut AS (
  SELECT c.lang, c.p, a, j, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
  JOIN f x ON x.lang = c.lang AND x.p = c.p[1 : j] JOIN f y ON y.lang = c.lang AND y.p = c.p[j + 1 : c.k]),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
covered AS (SELECT DISTINCT s.lang, s.p FROM c s JOIN c t ON t.lang = s.lang AND t.k = 3 AND s.k = 2 AND (t.p[1 : 2] = s.p OR t.p[2 : 3] = s.p) WHERE 100 * t.a >= 50 * s.a),
top AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(p, ' '))) AS rank, array_to_string(p, ' ') AS phrase, a, l, r, score
  FROM low ANTI JOIN covered USING (lang, p))
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM top JOIN total USING (lang) WHERE rank <= 2000
"""

ORACLES = {"op1_decontamination": DECONTAMINATION, "op5_host_reputation": HOST_REPUTATION, "op6_suffix_dedup": SUFFIX, "op7_jaccard_join": JACCARD, "op11_collocations": COLLOCATIONS, "op12_vector_codes": VECTOR_CODES}
