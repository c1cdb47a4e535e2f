"""DuckDB SQL of the registered queries that SQL can express, written from their definitions.

Regular expressions there have no lookbehind and know ASCII white space only; sentences are
cut at a sentinel.
"""

from __future__ import annotations

from ..functions import lexicons as L

LEX = L.TEST_LEXICON
_T = "coalesce(text, '')"
_S = f"list_filter(list_transform(string_split(regexp_replace({_T}, '([.!?])\\s+|\\n+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
_CLEAN = "trim(regexp_replace(regexp_replace({0}, '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}\\s.,;:!?()''\"/-]', ' ', 'g'), '\\s+', ' ', 'g'))"
_SIG = "array_to_string(list_filter(string_split_regex(regexp_replace(lower({0}), '[^a-z0-9\\s]', '', 'g'), '\\s+'), lambda x: x <> '')[1:{1}], ' ')"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def hits(words, low: str = "low") -> str:
    return " + ".join(f"contains({low}, {q(w)})::INT" for w in words) or "0"


def weight(weights, low: str = "low") -> str:
    return "greatest(0, " + ", ".join(f"CASE WHEN contains({low}, {q(w)}) THEN {n} ELSE 0 END" for w, n in weights.items()) + ")"


def d(text: str, kind: str = "DECIMAL(12,4)") -> str:
    return f"CAST({text} AS {kind})"


_POINTS = f"""
pt AS (SELECT doc_id, text, source, lower({_T}) AS low FROM documents),
pts AS (SELECT doc_id, text, source, low,
  least(28 * ({hits(LEX['domain_strong'])}) + 10 * ({hits(LEX['domain_medium'])}), 100) AS domain,
  least(25 * ({hits(LEX['product_strong'])}) + 10 * ({hits(LEX['product_medium'])}), 100) AS product,
  least(22 * ({hits(LEX['ai_strong'])}) + 8 * ({hits(LEX['ai_medium'])}), 100) AS ai,
  {weight(LEX['use_cases'])} AS use_case FROM pt)"""
_FIT = (
    _POINTS
    + """,
parts AS (SELECT *, CAST(domain * 0.35 AS DECIMAL(8,2)) AS b_domain, CAST(product * 0.25 AS DECIMAL(8,2)) AS b_product,
  CAST(ai * 0.20 AS DECIMAL(8,2)) AS b_ai, CAST(use_case * 0.20 AS DECIMAL(8,2)) AS b_use FROM pts),
fit AS (SELECT *, least(b_domain + b_product + b_ai + b_use, 100.00) AS total FROM parts)"""
)
_CATEGORY = "CASE WHEN total >= 75 THEN 'High Potential' WHEN total >= 55 THEN 'Good Potential' WHEN total >= 35 THEN 'Moderate' ELSE 'Low Potential' END"
_FLAG = "CASE WHEN length(coalesce(text, '')) >= 1000 THEN 'GOOD' WHEN length(coalesce(text, '')) >= 200 THEN 'LOW' ELSE 'FAILED' END"


def _rules(rules) -> str:
    return "(VALUES " + ", ".join(f"({i}, {q(w)}, {q(g)}, {n})" for i, (w, g, n) in enumerate(rules)) + ") r(o, word, label, weight)"


def _labels(rules, twice: bool) -> str:
    n = "(length(low) - length(replace(low, word, ''))) // length(word)"
    count = f"CASE WHEN NOT contains(word, ' ') AND {n} < 2 THEN 0 ELSE {n} END" if twice else n
    return f"""
t AS (SELECT doc_id, lower({_T}) AS low FROM documents),
c AS (SELECT doc_id, label, o, weight, {count} AS n FROM t, {_rules(rules)}),
g AS (SELECT doc_id, label, sum(weight * least(n, 3)) AS score, min(o) FILTER (n > 0) AS first FROM c GROUP BY ALL HAVING sum(n) > 0)"""


_DOMAIN = "regexp_replace(lower(regexp_extract(coalesce({0}, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\\.', '')"
_NORMAL = "regexp_replace(regexp_replace(url, '(?s)[?#].*$', ''), '/+$', '')"
_SITE = "string_split(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www\\.', ''), '/')[1]"
_VISIBLE = "regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', ' ', 'g')"
for _tag in ("script", "style", "noscript", "nav", "footer", "header", "svg"):
    _VISIBLE = f"regexp_replace({_VISIBLE}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}>', ' ', 'g')"
_VISIBLE = f"regexp_replace({_VISIBLE}, '(?s)<[^>]*>', ' ', 'g')"
for _entity, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    _VISIBLE = f"replace({_VISIBLE}, {q(_entity)}, {q(_char)})"
_VISIBLE = f"trim(regexp_replace({_VISIBLE}, '\\s+', ' ', 'g'))"
_HREF = """(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a>"""
_FIRST = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"
_OPENING = "CASE WHEN c = '' THEN '' ELSE regexp_replace(left(c, {0}), '[ ,;:]+$', '') || '.' END"


def _kept(least: int) -> str:
    return f"trim(regexp_replace(array_to_string(list_filter({_S}, lambda x: length(x) >= {least})[1:3], ' '), '\\s+', ' ', 'g'))"


def _any(words, low: str) -> str:
    return "(" + " OR ".join(f"contains({low}, {q(w)})" for w in words) + ")"


def _score_case(words, low: str, points: int) -> str:
    return " + ".join(f"CASE WHEN {low.format(q(w))} THEN {points} ELSE 0 END" for w in words)


def oracles(test_rules, test_first, test_links) -> dict[str, str]:
    same_line = "list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
    links = f"SELECT page_id, url, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS href, unnest(regexp_extract_all(html, '{_HREF}', 2)) AS anchor, unnest(range(len(regexp_extract_all(html, '{_HREF}', 1)))) AS k FROM pages"
    score = _score_case(test_links["hints"], "contains(lower(full_url), {0})", 10) + " + " + _score_case(test_links["keywords"], "(contains(lower(full_url), {0}) OR contains(lower(anchor), {0}))", 5)
    out = {
        "quality_flag_counts": f"SELECT {_FLAG} AS flag, count(*) AS n FROM documents GROUP BY 1",
        "length_gate_report": "SELECT count(*) AS total, count(*) FILTER (length(coalesce(text, '')) >= 800) AS ranked, CAST(0 AS BIGINT) AS crawl_errors, count(*) FILTER (length(coalesce(text, '')) < 800) AS too_short, CAST(0 AS BIGINT) AS no_signal, round(100.0::DOUBLE * count(*) FILTER (length(coalesce(text, '')) >= 800) / greatest(count(*), 1), 1) AS percent FROM documents",
        "sentence_split_stats": f"SELECT doc_id, CAST(len(s) AS INT) AS n_sentences, CAST(coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS INT) AS longest FROM (SELECT doc_id, {_S} AS s FROM documents)",
        "clean_text": f"SELECT doc_id, CAST(length(c) AS INT) AS n, md5(c) AS digest FROM (SELECT doc_id, {_CLEAN.format(_T)} AS c FROM documents)",
        "summary_first3": f"""SELECT doc_id, CASE WHEN c <> '' THEN regexp_replace(left(c, 350), '[ ,;:]+$', '') ELSE trim(regexp_replace(left({_T}, 350), ' [^ ]*$', ''), ' ' || chr(10)) END AS summary
          FROM (SELECT doc_id, text, array_to_string(list_filter({_S}, lambda x: length(x) >= 40)[1:3], ' ') AS c FROM documents)""",
        "short_summaries": f"""SELECT a.doc_id, {_OPENING.format(320).replace('c ', 'a.c ').replace('(c,', '(a.c,')} AS fast, {_OPENING.format(420).replace('c ', 'a.b ').replace('(c,', '(a.b,')} AS short,
          CASE WHEN length(t) < 50 THEN 'No meaningful content available.' ELSE array_to_string(list_transform(list_filter(string_split(t, '.'), lambda x: length(x) > 40), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))[1:2], '. ') || '.' END AS two
          FROM (SELECT doc_id, {_T} AS t, {_kept(40)} AS c, {_kept(0)} AS b FROM documents) a""",
        "signature_dedupe_sentences": f"""WITH s AS (SELECT doc_id, unnest({_S}) AS s, generate_subscripts({_S}, 1) - 1 AS pos FROM documents), k AS (SELECT *, {_SIG.format('s', 10)} AS sig FROM s WHERE length(s) >= 40)
          SELECT doc_id, CAST(pos AS INT) AS pos, md5(s) AS digest FROM k QUALIFY row_number() OVER (PARTITION BY sig ORDER BY doc_id, pos) = 1""",
        "merge_source_texts": f"""WITH c AS (SELECT doc_id, source, {_CLEAN.format(_T)} AS text FROM documents), s AS (SELECT source, doc_id, unnest({_S}) AS s, generate_subscripts({_S}, 1) AS p FROM c),
          k AS (SELECT *, {_SIG.format('s', 14)} AS sig FROM s WHERE length(s) >= 40), u AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY source, sig ORDER BY doc_id, p) = 1),
          b AS (SELECT *, coalesce(sum(length(s) + 1) OVER (PARTITION BY source ORDER BY doc_id, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u),
          m AS (SELECT source, left(string_agg(s, ' ' ORDER BY doc_id, p), 2800) AS m FROM b WHERE before < 2801 GROUP BY 1)
          SELECT source, CAST(length(m) AS INT) AS n, md5(m) AS digest FROM m""",
        "email_phone_price": f"""SELECT doc_id, nullif(regexp_extract({_T}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}'), '') AS email, nullif(trim(regexp_extract({_T}, '\\+?[0-9][0-9\\s().-]{{7,}}[0-9]')), '') AS phone,
          nullif(array_to_string(list_distinct_first[1:3], ', '), '') AS price FROM (SELECT doc_id, text, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_first FROM (SELECT doc_id, text, regexp_extract_all({_T}, '[$₹]\\s?[0-9][0-9,]*(?:\\.[0-9]{{1,2}})?') AS l FROM documents))""",
        "contact_hints": f"""SELECT doc_id, CASE WHEN {_any(('enterprise', 'premium', 'high-end'), 'low')} THEN 'High-end' WHEN {_any(('affordable', 'low cost', 'budget'), 'low')} THEN 'Budget' WHEN {_any(('$', 'pricing', 'quote'), 'low')} THEN 'Quoted' END AS bucket,
          left(list_filter(lines, lambda x: {_any(L.ADDRESS_HINTS, 'lower(x)')} AND regexp_matches(x, '[0-9]'))[1], 200) AS address, left(list_filter(s, lambda x: {_any(L.SPEC_SENTENCE_WORDS, 'lower(x)')})[1], 240) AS spec,
          nullif(left(array_to_string(list_filter(s, lambda x: len(string_split_regex(x, '\\s+')) >= 6)[1:2], ' '), 500), '') AS description
          FROM (SELECT doc_id, lower({_T}) AS low, {same_line} AS s, list_filter(list_transform(string_split_regex({_T}, '\\r\\n|[\\n\\r]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS lines FROM documents)""",
        "lexicon_hits": f"WITH {_POINTS} SELECT doc_id, domain, least(product + least(8 * len(list_filter(list_filter(string_split_regex({_T}, '\\s+'), lambda x: regexp_full_match(x, '[A-Z][a-z]+'))[1:3], lambda x: length(x) > 3)), 24), 100) AS product, ai, use_case FROM pts",
        "fit_score": f"WITH {_FIT} SELECT doc_id, CAST(total AS DOUBLE) AS score, {_CATEGORY} AS category FROM fit",
        "fit_rank_topk": f"WITH {_FIT} SELECT doc_id, source, CAST(total AS DOUBLE) AS score, {_CATEGORY} AS category FROM fit WHERE length(text) >= 800 ORDER BY total DESC, doc_id LIMIT 20",
        "weighted_label_argmax": f"WITH {_labels(test_rules, False)} SELECT d.doc_id, coalesce(l.label, '') AS label FROM documents d LEFT JOIN (SELECT doc_id, label FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, first) = 1) l USING (doc_id)",
        "topk_labels": f"WITH {_labels(test_rules, True)}, k AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, first) <= 4) SELECT d.doc_id, coalesce(x.labels, '') AS labels FROM documents d LEFT JOIN (SELECT doc_id, string_agg(label, ',' ORDER BY score DESC, first) AS labels FROM k GROUP BY 1) x USING (doc_id)",
        "first_match_label": "SELECT doc_id, CASE " + " ".join(f"WHEN contains(lower({_T}), {q(w)}) THEN {q(g)}" for w, g in test_first) + " END AS label FROM documents",
        "lexicon_join": f"SELECT word, count(*) AS n_docs FROM documents, {_rules(test_rules)} WHERE contains(lower({_T}), word) GROUP BY 1",
        "category_histogram": f"WITH {_FIT} SELECT {_CATEGORY} AS category, count(*) AS n, round(avg(CAST(total AS DOUBLE)), 4) AS mean_score FROM fit GROUP BY 1",
        "recommend_reason": f"""WITH {_FIT}, r AS (SELECT *, list_filter([CASE WHEN b_domain >= 12 THEN 'domain match (' || source || ')' END, CASE WHEN b_ai >= 8 THEN 'AI/vision capabilities' END, CASE WHEN b_use >= 8 THEN 'use case: aligned application' END, CASE WHEN b_use >= 10 THEN 'strong use-case alignment' END], lambda x: x IS NOT NULL) AS sig FROM fit)
          SELECT doc_id, CASE WHEN len(sig) = 0 THEN {q(L.WEAK_REASON.format(target=L.TARGET))} ELSE {q(L.FIT_REASON.format(target=L.TARGET))} || array_to_string(sig, '; ') || ' (score ' || regexp_replace(printf('%.2f', CAST(total AS DOUBLE)), '(\\.[0-9])0$', '\\1') || ').' END AS reason,
          CASE WHEN contains(low, 'thth') OR contains(low, 'license') THEN 'A1,A2' WHEN contains(low, 'eau') OR contains(low, 'sch') THEN 'B1' ELSE 'C1' END AS advice FROM r""",
        "penalised_score": f"""WITH {_FIT}, l AS (SELECT doc_id, max(quality) AS ql FROM labels GROUP BY 1), z AS (SELECT fit.doc_id, total, length({_T}) AS n, {_FLAG} AS f, coalesce(ql = 1, false) AS ok FROM fit LEFT JOIN l USING (doc_id)),
          m AS (SELECT *, CAST((CASE f WHEN 'GOOD' THEN 1.00 WHEN 'LOW' THEN 0.70 ELSE 0.50 END) * (CASE WHEN ok THEN 1.00 ELSE 0.60 END) AS DECIMAL(4,2)) AS mult, CASE WHEN NOT ok THEN 10 WHEN f = 'LOW' THEN 5 WHEN n % 100 < 45 THEN 5 ELSE 0 END AS pen FROM z)
          SELECT doc_id, CAST(greatest(least(CAST(total * mult - pen AS DECIMAL(10,2)), 100.00), 0.00) AS DOUBLE) AS score FROM m""",
        "need_score": f"SELECT doc_id, CAST(least(9 * ({hits(('ation', 'thth', 'eau', 'sch', 'ción', 'license'), f'lower({_T})')}), 100) AS DOUBLE) AS need FROM documents",
        "roster_dedupe": f"SELECT page_id, {_DOMAIN.format('url')} AS name, trim(url) AS website FROM pages WHERE url IS NOT NULL AND trim(url) <> '' AND {_DOMAIN.format('url')} <> '' QUALIFY row_number() OVER (PARTITION BY lower({_DOMAIN.format('url')}), {_SITE} ORDER BY page_id) = 1",
        "url_parts": f"SELECT page_id, {_NORMAL} AS normal, {_SITE} AS site, regexp_replace(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS cache, contains(lower(url), 'privacy') OR contains(lower(url), 'blog') OR regexp_matches(regexp_replace(lower(url), '[?#].*$', ''), '\\.(pdf|html)$') AS skip, contains(lower(url), 'en') OR contains(lower(url), 'fr') AS relevant FROM pages",
        "pages_per_domain": f"SELECT {_DOMAIN.format('url')} AS domain, count(*) AS n FROM pages GROUP BY 1",
        "visible_text": f"SELECT page_id, CAST(length(v) AS INT) AS n, md5(v) AS digest FROM (SELECT page_id, {_VISIBLE} AS v FROM pages)",
        "page_links": f"SELECT page_id, count(*) AS n_links, count(DISTINCT trim(href)) AS n_distinct FROM ({links}) GROUP BY 1",
        "link_scores_top6": f"""WITH l AS ({links}), f AS (SELECT page_id, k, regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*') || trim(href), '(?s)[?#].*$', ''), '/+$', '') AS full_url, anchor FROM l WHERE starts_with(trim(href), '/')),
          s AS (SELECT page_id, full_url, max({score}) AS score, min(k) AS k FROM f WHERE NOT contains(lower(full_url), 'privacy') AND ({score}) > 0 GROUP BY 1, 2)
          SELECT page_id, CAST(row_number() OVER w - 1 AS INT) AS rank, full_url AS url, CAST(score AS INT) AS score FROM s WINDOW w AS (PARTITION BY page_id ORDER BY score DESC, k) QUALIFY row_number() OVER w <= 6""",
        "left_join_defaults": "SELECT c_custkey, c_mktsegment, coalesce(n_orders, 0) AS n_orders, coalesce(spent, 0.0::DOUBLE) AS spent FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1) USING (c_custkey)",
        "semi_qualified": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
        "anti_unseen": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
        "grounded_items": "SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains(lower(coalesce(d.text, '')), lower(b.text))",
        "last_write_wins": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
        "ttl_fresh": "SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY 1",
        "call_metrics": "SELECT count(*) AS calls, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'error') AS timeouts, count(*) FILTER (event_type = 'retry') AS retried, round(avg(value), 4) AS mean_seconds, round(100.0::DOUBLE * count(*) FILTER (event_type <> 'error') / count(*), 2) AS success_rate FROM events",
        "json_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
        "cosine_topk": f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_FIRST}::DOUBLE[]), 4) AS likeness FROM embeddings ORDER BY 2 DESC, 1 LIMIT 10",
        "semantic_score": f"SELECT vec_id, round(round(greatest(least(list_cosine_similarity(embedding::DOUBLE[], {_FIRST}::DOUBLE[]), 1.0), 0.0) * 100, 2), 1) AS score FROM embeddings",
        "centroid_classify": """WITH u AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, list(m ORDER BY i) AS centre FROM (SELECT label, i, avg(x) AS m FROM u GROUP BY ALL) GROUP BY 1)
          SELECT vec_id, c.label AS nearest, round(round(round(list_cosine_similarity(embedding::DOUBLE[], centre), 9), 6), 4) AS likeness FROM embeddings, c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], centre), 9) DESC, c.label) = 1""",
        "token_counts": f"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower_ascii, '[a-zA-Z0-9]+')) AS tok FROM (SELECT doc_id, {_T} AS lower_ascii FROM documents)), c AS (SELECT doc_id, lower(tok) AS tok, count(*) AS n FROM t GROUP BY ALL) SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_tokens, count(*) AS n_distinct, max(n) AS most FROM c GROUP BY 1",
        "embedding_keys": f"SELECT doc_id, sha1(left(regexp_replace({_T}, '^\\s+|\\s+$', '', 'g'), 1200)) AS key FROM documents",
        "name_search": "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '00012')",
        "dashboard_summary": "SELECT count(*) AS n, arg_max(s_name, s_acctbal) AS top_name, max(s_acctbal) AS top_score, round(coalesce(avg(s_acctbal), 0), 4) AS mean_score FROM supplier",
        "csv_json_projection": f"""WITH {_FIT}, p AS (SELECT *, list_filter(string_split_regex({_T}, '\\s+'), lambda x: regexp_full_match(x, '[A-Z][a-z]+'))[1:2] AS names FROM fit)
          SELECT CAST(doc_id AS VARCHAR) AS website, source AS company_name, CAST(total AS DOUBLE) AS score, (length({_T}) % 100) / 100.0::DOUBLE AS confidence, CASE WHEN len(names) = 0 THEN '' ELSE '[' || array_to_string(list_transform(names, lambda x: '{{"name":"' || x || '","specifications":""}}'), ',') || ']' END AS products, '' AS category FROM p""",
        "title_tokens": "SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(p_name, '[A-Za-z0-9&+\\-]+'), lambda x: CASE WHEN x = upper(x) AND x <> lower(x) THEN x ELSE upper(x[1]) || lower(x[2:]) END), ' ') AS title FROM part",
        "source_coverage": f"SELECT source, round(count(*) FILTER (regexp_matches({_T}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}') OR regexp_matches({_T}, '\\+?[0-9][0-9\\s().-]{{7,}}[0-9]'))::DOUBLE / count(*), 4) AS coverage FROM documents GROUP BY 1",
        "keyword_sections": f"""WITH s AS (SELECT doc_id, list_filter({_S}, lambda x: {_any(('license', 'thth', 'eau'), 'lower(x)')}) AS s FROM documents), k AS (SELECT doc_id, list_filter(s, lambda x, i: list_position(list_transform(s, lambda y: lower(y)), lower(x)) = i) AS k FROM s)
          SELECT doc_id, CAST(len(k) AS INT) AS n, md5(coalesce(array_to_string(k, chr(10)), '')) AS digest FROM k""",
        "extraction_lines": f"""WITH n AS (SELECT doc_id, list_filter(list_transform({_S}, lambda x: regexp_replace(regexp_replace(x, '\\s+', ' ', 'g'), '^[ ,.;:-]+|[ ,.;:-]+$', '', 'g')), lambda x: x <> '' AND len(string_split(x, ' ')) <= 22) AS l FROM documents)
          SELECT doc_id, coalesce(array_to_string(list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: {_SIG.format('y', 10)}), {_SIG.format('x', 10)}) = i)[1:4], chr(10)), '') AS lines FROM n""",
        "conversation_merge": "WITH f AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY ALL) SELECT conv_id, string_agg(role, ',' ORDER BY t) AS roles, any_value(digest) AS digest FROM f JOIN (SELECT conv_id, md5(arg_min(text, turn) FILTER (coalesce(text, '') <> '')) AS digest FROM conversations GROUP BY 1) USING (conv_id) GROUP BY 1",
    }
    return out


def _build() -> dict[str, str]:
    from . import cases_sql, catalogue, tables_sql

    return oracles(catalogue.TEST_RULES, catalogue.TEST_FIRST, catalogue.TEST_LINKS) | cases_sql.oracles(catalogue.TEST_LINKS) | tables_sql.oracles()


ORACLES = _build()
