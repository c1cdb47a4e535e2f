"""DuckDB SQL of the queries in ``tables``, written from their definitions."""

from __future__ import annotations

from ..functions import lexicons as L
from . import cases_sql
from .cases_sql import frontier
from .sql import _S, _VISIBLE, _any
from .tables import SITE_LINKS, SYLLABLES

_WORDS = "(SELECT DISTINCT unnest(list_filter(string_split_regex(lower(t), '\\s+'), lambda w: w <> '')) AS word FROM (SELECT p_name AS t FROM part UNION ALL SELECT text FROM benchmark) WHERE t IS NOT NULL)"
#: The words hold no white space, so they are met with the runs of characters of distinct tokens.
_MET = f"""
w AS MATERIALIZED {_WORDS},
t AS MATERIALIZED (SELECT doc_id, tok, count(*) AS c FROM (SELECT doc_id, unnest(string_split_regex(lower(coalesce(text, '')), '\\s+')) AS tok FROM documents) GROUP BY ALL),
k AS (SELECT DISTINCT length(word) AS k FROM w),
u AS (SELECT DISTINCT tok FROM t),
g AS (SELECT tok, unnest(list_transform(range(1, length(tok) - k + 2), lambda i: substr(tok, i, k))) AS word FROM u, k WHERE length(tok) >= k),
m AS MATERIALIZED (SELECT tok, word, count(*) AS n, (length(tok) - length(replace(tok, word, ''))) // length(word) AS n_apart FROM g SEMI JOIN w USING (word) GROUP BY ALL),
a AS (SELECT doc_id, word, sum(c * n) AS n, sum(c * n_apart) AS n_apart FROM t JOIN m USING (tok) GROUP BY ALL)"""
_SUPPLIERS = """s AS (SELECT s_suppkey AS ord, CASE WHEN s_nationkey <> 3 THEN s_name END AS name, 'site' || s_suppkey AS website, floor(s_acctbal / 100)::DOUBLE AS score, s_nationkey / 7 AS confidence, s_name FROM supplier),
p AS (SELECT *, row_number() OVER (ORDER BY score DESC, ord) AS position FROM s)"""


def _plain(x: str) -> str:
    """Text of markup without scripts."""
    out = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    return out


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _parts(most: int | None = None) -> str:
    """Pages there have one article: a heading, and paragraphs of which some, beginning with <b>, stay open to its end."""
    main = """trim(regexp_replace(regexp_replace(t, '[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}\\s.,;:!?()''"/-]', ' ', 'g'), '\\s+', ' ', 'g'))"""
    main = main if most is None else f"left({main}, {most})"
    block = f"CASE WHEN starts_with(parts[i], '<b>') THEN {_strip(_plain("array_to_string(parts[i:], '')"))} ELSE {_strip(_plain("regexp_replace(parts[i], '(?s)</p>.*$', '')"))} END"
    return f"""
a AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1) AS art FROM pages),
b AS (SELECT page_id, {_strip(_plain("regexp_extract(art, '(?s)<h1>(.*?)</h1>', 1)"))} AS h, string_split(art, '<p>')[2:] AS parts FROM a),
c AS (SELECT page_id, list_filter([h], lambda t: length(t) > 10 AND length(t) < 200) || list_filter(list_transform(range(1, len(parts) + 1), lambda i: {block}), lambda t: length(t) > 20 AND length(t) < 800) AS l FROM b),
j AS (SELECT page_id, regexp_replace(array_to_string(l, ' '), '\\s+', ' ', 'g') AS t FROM c)
SELECT page_id, {main} AS main FROM j"""


def _sections() -> str:
    texts = lambda pattern: f"list_transform(regexp_extract_all(html, '{pattern}', 1), lambda x: {_strip(_plain('x'))})"
    return f"""WITH t AS (SELECT page_id, {texts('(?s)<div class="ad">(.*?)</div>')} AS ad, {texts('(?s)<li>(.*?)</li>')} AS li, {texts('(?s)<ul>(.*?)</ul>')} AS ul, {texts('(?s)<h1>(.*?)</h1>')} AS h FROM pages)
SELECT page_id, coalesce(array_to_string(list_filter(ad || li, lambda x: length(x) > 15 AND length(x) < 1000)[1:5], ' '), '') AS sections,
  coalesce(array_to_string(list_filter([array_to_string(li, ' | ')], lambda x: length(x) > 15 AND length(x) < 500), ' '), '') AS rows,
  coalesce(array_to_string(list_filter(list_filter(h, lambda x: length(x) > 15 AND length(x) < 120), lambda x: NOT {{blacklist}})[1:10], ' '), '') AS headings FROM t"""


def _sites() -> str:
    from .sql import _HREF

    anchor = _strip("regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')")
    links = f"list_transform(list_transform(regexp_extract_all(coalesce(html, ''), '{_HREF}', 2), lambda x: {anchor})[1:5], lambda a, i: '<a href=\"/en/p' || ((page_id % 25) * 3 + i - 1) % 25 || '\">' || replace(a, '<', '') || '</a>')"
    return f"(SELECT page_id, 'https://s' || page_id // 25 || '.example' AS root, 'https://s' || page_id // 25 || '.example/en/p' || page_id % 25 AS url, coalesce(array_to_string({links}, ' '), '') AS html FROM pages)"


def _depth(sites: str | None = None) -> str:
    return f"""WITH RECURSIVE p AS MATERIALIZED {sites or _sites()},
t AS MATERIALIZED (SELECT url, min(html) AS html FROM (SELECT url, html FROM p UNION ALL SELECT root, html FROM p) GROUP BY 1),
h AS (SELECT url, regexp_extract(url, '^(https://[^/]+)', 1) AS root, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hs FROM t),
o AS (SELECT url, root || e AS to_url, i - 1 AS k FROM (SELECT url, root, unnest(hs) AS e, unnest(range(1, len(hs) + 1)) AS i FROM h)),
l AS MATERIALIZED (SELECT url, to_url, dense_rank() OVER (PARTITION BY url ORDER BY min(k)) AS k FROM o GROUP BY url, to_url HAVING contains(to_url, 'p1') OR contains(to_url, 'p2')),
w AS (SELECT DISTINCT root AS site, root AS url, 0 AS depth, []::BIGINT[] AS way, [root] AS seen FROM p
  UNION ALL SELECT w.site, l.to_url, depth + 1, list_append(way, k), list_append(seen, l.to_url) FROM w JOIN l ON l.url = w.url WHERE depth < 2 AND NOT list_contains(seen, l.to_url)),
b AS (SELECT site, url, min(depth) AS depth, arg_min(way, (depth, way)) AS way FROM w GROUP BY 1, 2),
r AS (SELECT site, b.url, depth, html, row_number() OVER (PARTITION BY site ORDER BY depth, way) AS n FROM b JOIN t ON t.url = b.url)"""


def _extraction() -> str:
    body = f"replace(replace({cases_sql.worded('text')}, '&', ' '), '<', ' ')"
    for syllable, phrase in SYLLABLES:
        body = f"replace({body}, '{syllable}', ' {phrase} ')"
    sites = f"(SELECT s.page_id, root, url, html || '<p>' || coalesce(body, '') || '</p>' AS html FROM {_sites()} s LEFT JOIN (SELECT doc_id, {body} AS body FROM documents) d ON d.doc_id = s.page_id)"
    folded = lambda x: f"list_filter({x}, lambda y, i: list_position(list_transform({x}, lambda z: lower(z)), lower(y)) = i)"
    items = lambda c: f"list_filter(flatten(list(string_split({c}, ',') ORDER BY n)), lambda y: y <> '')"
    return f"""{_depth(sites)},
v AS (SELECT site || '#' || n AS doc_id, site, n, text FROM (SELECT site, n, {_VISIBLE} AS text FROM r WHERE n <= 8)),
g AS (SELECT doc_id, site, n, list_filter({_S}, lambda x: {_any(L.SECTION_WORDS, 'lower(x)')}) AS l FROM v),
x AS MATERIALIZED (SELECT doc_id, site, n, coalesce(array_to_string({folded('l')}, chr(10)), '') AS text FROM g),
k AS MATERIALIZED ({cases_sql.keyword_profiles('x')}),
m AS (SELECT site, {items('products')} AS ps, {items('technologies')} AS ts, arg_min(industry, n) FILTER (industry <> '') AS industry, round(count(*) FILTER (products <> '' OR technologies <> '' OR industry <> '') / count(*), 4) AS confidence FROM x JOIN k USING (doc_id) GROUP BY site)
SELECT site AS website, site AS company_url, coalesce(array_to_string({folded('ps')}, '|'), '') AS products, coalesce(array_to_string({folded('ts')}, '|'), '') AS technologies, coalesce(industry, '') AS industry, confidence FROM m
UNION ALL SELECT 'https://nowhere.example', 'https://nowhere.example', '', '', '', 0.0"""


def oracles() -> dict[str, str]:
    documents = f"FROM (SELECT doc_id, source, {cases_sql.worded('text')} AS text FROM documents)"
    of_worded = lambda sql: sql.replace("FROM documents", documents)
    return {
        "word_occurrences": f"WITH {_MET} SELECT word, count(*) AS n_docs, sum(n)::BIGINT AS n, sum(n_apart)::BIGINT AS n_apart FROM a GROUP BY word",
        "rule_totals": f"WITH {_MET} SELECT doc_id, word[1] AS label, sum(least(n_apart, 3) * length(word))::BIGINT AS total, count(*) AS words FROM a WHERE length(word) > 3 GROUP BY ALL",
        "worded_records": of_worded(cases_sql.company_records()),
        "worded_profiles": of_worded(cases_sql.mixed_profiles()),
        "page_main_text": f"WITH {_parts()}",
        "section_text": _sections().format(blacklist=_any(L.HEADING_BLACKLIST, "lower(x)")),
        "tag_intervals": """WITH t AS (SELECT unnest(regexp_extract_all(html, '<([a-z0-9]+)', 1)) AS tag FROM pages), i AS (SELECT unnest(regexp_extract_all(regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1), '<([a-z0-9]+)', 1)) AS tag FROM pages)
          SELECT tag, n, coalesce(inside, 0) AS inside FROM (SELECT tag, count(*) AS n FROM t GROUP BY 1) LEFT JOIN (SELECT tag, count(*) AS inside FROM i GROUP BY 1) USING (tag)""",
        "crawl_queue": frontier(SITE_LINKS, _sites()),
        "crawl_depth_pages": f"{_depth()} SELECT site AS website, depth, url, md5(html) AS digest FROM r WHERE n <= 12",
        "company_extraction": _extraction(),
        "vector_neighbours_exact": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT q.vec_id, e.vec_id AS neighbour, list_cosine_similarity(q.v, e.v) AS likeness FROM e q JOIN e ON e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
          SELECT vec_id, rank, neighbour, round(likeness, 6) AS likeness FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(likeness, 9) DESC, neighbour) AS rank FROM p) WHERE rank <= 10""",
        "props_fields": """WITH e AS (SELECT event_id, event_type, props, substr(props, 7, length(props) - 7) AS k FROM events), v AS (SELECT event_id, event_type, k, event_id % 6 AS f FROM e)
          SELECT event_id, f <> 3 AS ok, CASE f WHEN 0 THEN 'scalar' WHEN 1 THEN 'list' WHEN 2 THEN 'object' WHEN 5 THEN 'scalar' END AS kind, CASE f WHEN 2 THEN event_type WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE k END AS text,
            CASE f WHEN 1 THEN k || '|' || event_type WHEN 2 THEN event_type WHEN 3 THEN '' WHEN 4 THEN '' ELSE k END AS items FROM v""",
        "reply_fields": """WITH c AS (SELECT conv_id, turn, role, (conv_id + turn) % 4 AS f, coalesce(array_to_string(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: regexp_matches(w, '^[A-Za-z]+$'))[1:3], '|'), '') AS w FROM conversations)
          SELECT conv_id, turn, f <> 3 AS ok, CASE WHEN f = 3 THEN '' ELSE w END AS products, CASE WHEN f <> 3 THEN role END AS industry FROM c""",
        "degraded_report": """WITH l AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1), o AS (SELECT doc_id, q = 1 AS ok, (length(coalesce(text, '')) % 100) / 100 AS c,
            CASE WHEN doc_id % 17 = 0 THEN 'crawl_error' WHEN length(coalesce(text, '')) < 800 THEN 'too_short' WHEN doc_id % 13 = 0 AND q IS NULL THEN 'no_signal' END AS why FROM documents LEFT JOIN l USING (doc_id)),
          r AS (SELECT count(*) AS total, count(*) FILTER (why IS NULL) AS ranked, count(*) FILTER (why = 'crawl_error') AS crawl_errors, count(*) FILTER (why = 'too_short') AS too_short, count(*) FILTER (why = 'no_signal') AS no_signal,
            count(*) FILTER (why IS NULL AND coalesce(ok, false) AND c >= 0.45) AS full_, count(*) FILTER (NOT coalesce(ok, false) AND (why IS NULL OR why = 'no_signal')) AS llm_fallback, count(*) FILTER (why IS NULL AND coalesce(ok, false) AND c < 0.45) AS low_confidence FROM o)
          SELECT total, ranked, crawl_errors, too_short, no_signal, full_ AS "full", llm_fallback, low_confidence, round(100.0::DOUBLE * ranked / total, 1) AS percent FROM r""",
        "cache_upserts_by_folder": """WITH k AS (SELECT user_id, event_id, value, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
          SELECT CAST(user_id AS VARCHAR) AS website_key, event_id, value FROM k WHERE user_id % 2 = 0 AND ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR""",
        "bucketed_vectors": f"""WITH h AS (SELECT doc_id, sha1(cut) AS key, length(cut)::DOUBLE AS n FROM (SELECT doc_id, left({_strip("coalesce(text, '')")}, 1200) AS cut FROM documents)), c AS (SELECT DISTINCT key FROM h WHERE doc_id IN (SELECT doc_id FROM labels))
          SELECT doc_id, h.key, CASE WHEN c.key IS NULL THEN n ELSE -n END AS value FROM h LEFT JOIN c ON h.key = c.key""",
        "input_health": "SELECT 'supplier' AS input, true AS file_exists, true AS file_readable, count(*) AS row_count FROM supplier UNION ALL SELECT 'customer', true, true, count(*) FROM customer UNION ALL SELECT 'nation', true, true, count(*) FROM nation UNION ALL SELECT 'missing', false, false, 0",
        "service_answers": """WITH n AS (SELECT count(*) AS n FROM supplier) SELECT step, status, coalesce(k, n) AS n_rows, running, n_started
          FROM n, (VALUES ('none yet', 202, -1, true, 1), ('still none', 202, -1, true, 1), ('fresh', 200, NULL, false, 1), ('old', 200, NULL, true, 2), ('error', 500, -1, true, 2)) v(step, status, k, running, n_started)""",
        "main_text": f"SELECT page_id, length(main) AS n_main, length(listed) AS n_spec, length(headings) AS n_head FROM (WITH {_parts(4000)}) JOIN ({cases_sql.headings()}) USING (page_id)",
        "name_postings": """WITH cq AS (SELECT right(c_name, 4) AS query FROM customer WHERE c_custkey % 50 = 0 UNION SELECT upper(substr(c_name, 6, 9)) FROM customer WHERE c_custkey % 70 = 0),
          pq AS (SELECT unnest(list_filter(string_split_regex(p_name, '\\s+'), lambda w: w <> '')) AS query FROM part UNION SELECT substr(p_name, 3, 2) FROM part UNION SELECT substr(p_name, 2, 7) FROM part)
          SELECT 'customer' AS kind, query, c_custkey AS id FROM cq JOIN customer ON contains(lower(c_name), lower(query)) WHERE query <> '' UNION ALL SELECT 'part', query, p_partkey FROM pq JOIN part ON contains(lower(p_name), lower(query)) WHERE query <> ''""",
        "ranked_positions": "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, r) AS position FROM (SELECT c_custkey, c_acctbal, row_number() OVER () AS r FROM customer)",
        "results_read_back": f"""WITH {_SUPPLIERS} SELECT form, position, coalesce(name, CASE WHEN form = 'csv' THEN 'Unknown Company' ELSE 'Unknown' END) AS company_name, website, score, s_name AS product, round(confidence, 4) AS confidence,
          'two' || chr(10) || 'lines' AS reason FROM p, (VALUES ('lines'), ('array'), ('csv')) f(form)""",
        "dashboard_ids": f"WITH {_SUPPLIERS} SELECT ord, coalesce(name, 'company') || '-' || website || '-' || (position - 1) AS id, coalesce(name, 'Unknown') AS company_name, position FROM p",
    }
