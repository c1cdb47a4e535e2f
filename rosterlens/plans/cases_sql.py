"""DuckDB SQL of the queries in ``cases``, written from their definitions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from ..functions import lexicons as L
from ..operators.crawl import SANDBOX
from . import cases as C
from .sql import _DOMAIN, _S, _T, _any, d, hits, q

Value = str | int | float | bool | None | Sequence


def lit(v: Value) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return q(v)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(lit, v)) + "]::VARCHAR[]"
    return str(v)


def rows(table: Iterable[Sequence[Value]], names: str) -> str:
    """An inline table to select from."""
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in table) + f") v({names}))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def strip_of(x: str, chars: str) -> str:
    return f"regexp_replace({x}, {q(f'^[{chars}]+|[{chars}]+$')}, '', 'g')"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


def bare(x: str) -> str:
    return f"regexp_replace(lower({x}), '[.,;:!?]+$', '')"


def among(x: str, items: Iterable[str]) -> str:
    return f"coalesce({x} IN ({', '.join(q(i) for i in items)}), false)"


def distinct(items: str) -> str:
    return f"list_transform(list_filter(list_zip({items}, range(1, len({items}) + 1)), lambda z: list_position({items}, z[1]) = z[2]), lambda z: z[1])"


def some(items: str, test: str) -> str:
    """Whether ``test`` of w holds for an item."""
    return f"(len(list_filter({items}, lambda w: {test})) > 0)"


def every(items: str, test: str) -> str:
    return f"(len(list_filter({items}, lambda w: NOT coalesce({test}, false))) = 0)"


def csv(items: str) -> str:
    return f"coalesce(array_to_string({items}, '|'), '')"


def split(x: str, pattern: str) -> str:
    return f"list_filter(list_transform(string_split_regex({x}, {q(pattern)}), lambda y: {strip('y')}), lambda y: y <> '')"


BRAND = r"\b[A-Z][a-z]+(?:[A-Z][a-z]*)+\b|\b[A-Z]{2,5}(?:[0-9]+)?\b|\b[A-Z][a-z]+ [A-Z][a-z]+"
CONTEXT = r"(?i)\b(?:product|platform|software|system|solution|tool|suite|robot|drone|vehicle|device|sensor|engine|sdk|api)\b"


def brand_token(word: str) -> str:
    t = strip_of(word, ".,;:!?")
    ending = "|".join(L.BRAND_SUFFIXES)
    return f"(regexp_full_match({t}, '[A-Z][a-z]+([A-Z][a-z]*)+') OR regexp_full_match({t}, '[A-Z]{{2,6}}[0-9]{{0,3}}') OR (regexp_matches({t}, '^[A-Z]') AND (regexp_matches({t}, '[0-9]') OR (regexp_matches(lower({t}), '({ending})$') AND length({t}) > 4))))"


def technologies(low: str, existing: str) -> str:
    """``low`` is padded with spaces. Each found name joins unless one holds the other."""
    found = " || ".join(f"CASE WHEN contains({low}, {q(k)}) THEN [[{q(c)}]] ELSE [] END" for k, c in L.TECHNOLOGIES)
    near = "len(list_filter(acc, lambda y: contains(lower(y), lower(one[1])) OR contains(lower(one[1]), lower(y)))) > 0"
    return distinct(f"list_reduce({found}, lambda acc, one: CASE WHEN {near} THEN acc ELSE acc || one END, {existing})")


def products(text: str) -> str:
    banned = sorted(set(L.RESCUE_SKIP) | set(L.GENERIC_TERMS))
    # Few sentences bring names; each is a list, and lists join until there are three names.
    found = f"list_filter(list_transform(regexp_extract_all(s, {q(BRAND)}), lambda t: {strip('t')}), lambda t: NOT {among('lower(t)', banned)} AND length(t) BETWEEN 3 AND 40)"
    per = f"list_transform(list_filter(string_split_regex({text}, '[.!?\\n]+'), lambda s: regexp_matches(s, {q(CONTEXT)})), lambda s: {found})"
    joined = f"list_reduce({per}, lambda acc, one: CASE WHEN len(acc) >= 3 THEN acc ELSE acc || list_filter(list_distinct_in_order(one), lambda t: NOT list_contains(acc, t)) END, []::VARCHAR[])"
    inner = "list_filter(one, lambda t, i: list_position(one, t) = i)"
    joined = joined.replace("list_distinct_in_order(one)", inner)
    return f"list_filter({joined}, lambda t: NOT {among('lower(t)', sorted({c.lower() for _, c in L.TECHNOLOGIES}))})[1:3]"


def label_table(name: str, source: str, rules, twice: bool) -> str:
    """Scores of labels for (doc_id, low) rows: name(doc_id, label, score, first)."""
    table = "(VALUES " + ", ".join(f"({i}, {q(w)}, {q(g)}, {n})" for i, (w, g, n) in enumerate(rules)) + ") r(o, word, label, weight)"
    n = "(length(low) - length(replace(low, word, ''))) // length(word)"
    n = f"CASE WHEN NOT contains(word, ' ') AND {n} < 2 THEN 0 ELSE {n} END" if twice else n
    first = "min(o) FILTER (m > 0)"
    return f"""{name} AS (SELECT doc_id, label, sum(weight * least(m, 3)) AS score, {first} AS first FROM (SELECT doc_id, label, o, weight, {n} AS m FROM {source}, {table} WHERE contains(low, word)) GROUP BY ALL HAVING sum(m) > 0)"""


def best(name: str) -> str:
    return f"(SELECT doc_id, label FROM {name} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, first) = 1)"


def ratio(n: str, of: int, weight: str) -> str:
    return f"least({d(f'{n} / {of}', 'DECIMAL(14,6)')}, 1) * {weight}"


def specific(technologies_: str) -> str:
    return "(" + " + ".join(f"(len(list_filter({technologies_}, lambda w: contains(lower(w), {q(t)}))) > 0)::INT" for t in L.SPECIFIC_TECHNOLOGIES) + ")"


def fallback_confidence(tech: str, industry: str, n_uses: str) -> str:
    raw = f"{ratio(specific(tech), 4, '0.18')} + {ratio(f'len({tech})', 5, '0.10')} + CASE WHEN {industry} <> '' THEN 0.07 ELSE 0 END + {ratio(n_uses, 3, '0.08')}"
    return f"CAST(round(least(greatest({raw}, 0.30), 0.40), 2) AS DOUBLE)"


def keyword_profiles(source: str) -> str:
    return f"""WITH src AS (SELECT doc_id, coalesce(text, '') AS text, lower(coalesce(text, '')) AS low FROM {source}),
      {label_table('ind', 'src', L.INDUSTRY_SIGNALS, False)}, {label_table('use', 'src', L.USE_CASE_SIGNALS, True)},
      u AS (SELECT doc_id, string_agg(label, ',' ORDER BY score DESC, first) AS use_cases, count(*) AS n FROM (SELECT * FROM use QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, first) <= 4) GROUP BY 1),
      t AS (SELECT doc_id, {technologies("(' ' || low || ' ')", '[]::VARCHAR[]')} AS t, {products('text')} AS p FROM src)
      SELECT doc_id, coalesce(array_to_string(t[1:8], ','), '') AS technologies, coalesce(array_to_string(p, ','), '') AS products, coalesce(i.label, '') AS industry, coalesce(use_cases, '') AS use_cases,
        {fallback_confidence('t', "coalesce(i.label, '')", 'coalesce(n, 0)')} AS confidence FROM t LEFT JOIN {best('ind')} i USING (doc_id) LEFT JOIN u USING (doc_id)"""


def worded(x: str) -> str:
    for needle, piece in zip(C.NEEDLES, C.PIECES, strict=False):
        x = f"replace({x}, {q(needle)}, {q(f' {piece} ')})"
    return x


def dealt(table: Iterable[Sequence[Value]], names: str, select: str, source: str = "documents", key: str = "doc_id") -> str:
    """Rows of a given table beside those of an inline one by the remainder of the key."""
    table = [(i, *r[1:]) for i, r in enumerate(table)]
    return f"(SELECT {select} FROM {source} JOIN {rows(table, 'k, ' + names)} v ON v.k = {key} % {len(table)})"


_TEXTS = f"(SELECT doc_id, {worded('text')} AS text FROM documents)"
_STRINGS = dealt(C.STRINGS, "s", "p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN s ELSE s || ', ' || p_name || ' and One thing' END AS s", "part", "p_partkey")


_CELLS = dealt(C.CELLS, "cell", "p_partkey AS id, replace(cell, 'Kit', p_name) AS cell", "part", "p_partkey")
_ROSTER = """(SELECT s_suppkey AS n, CASE s_suppkey % 7 WHEN 0 THEN ' ' || lower('Firm ' || s_suppkey % 40) || ' ' WHEN 3 THEN '' ELSE 'Firm ' || s_suppkey % 40 END AS name,
  CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'https://www.f' || s_suppkey % 20 || '.example/home' WHEN 2 THEN 'http://f' || s_suppkey % 20 || '.example' ELSE 'f' || s_suppkey % 20 || '.example' END AS site FROM supplier)"""


def _clean_items(raw: str) -> str:
    return f"list_filter(list_transform({raw}, lambda x: {strip_of(strip('x'), chr(34) + chr(39))}), lambda x: x <> '')"


def _clean_names() -> str:
    generic = sorted(set(L.GENERIC_NOUNS) | set(L.GENERIC_TERMS))
    plain = sorted(set(generic) | set(L.SENTENCE_STARTERS) | set(L.VERBS))
    w = words("x")
    first = bare(f"{w}[1]")
    tokens = f"list_filter({w}, lambda w: length(w) > 4 AND NOT {among('lower(w)', L.GENERIC_IN_PRODUCTS)})"
    grounded = f"CASE WHEN len({tokens}) = 0 THEN contains(low, lower(x)) ELSE {some(tokens, 'contains(low, lower(w))')} END"
    unnamed = f"(NOT {some(w, brand_token('w'))} AND ((len({w}) = 2 AND {every(w, among(bare('w'), generic))}) OR {every(w, among(bare('w'), plain))}))"
    bad = f"""(len({w}) NOT BETWEEN 1 AND 5 OR {among(first, (*L.SENTENCE_STARTERS, *L.PRODUCT_VERB_PREFIXES))} OR (ends_with({first}, 'ing') AND length({first}) > 5)
      OR (ends_with({first}, 'ed') AND length({first}) > 4 AND NOT {among(first, ('named', 'called'))}) OR {some(f'{w}[2:]', among(bare('w'), L.SENTENCE_STARTERS))} OR {among('lower(x)', L.GENERIC_TERMS)}
      OR NOT {some(w, "regexp_matches(w, '^[A-Z]')")} OR {some(w, among(bare('w'), L.VERBS))} OR regexp_matches(x, '[.!?]\\s') OR {unnamed})"""
    good_products = distinct("pp") + "[1:5]"
    known = sorted({c.lower() for _, c in L.TECHNOLOGIES} | set(L.SPECIFIC_TECHNOLOGIES))
    technical = f"({some(w, '''regexp_matches(w, '^[A-Z]{2,}[0-9]*$|^[A-Z][a-z]+[A-Z]')''')} OR {_any(L.TECH_PARTS, 'lower(x)')})"
    bad_tech = f"(len({w}) > 4 OR {among('lower(x)', L.GENERIC_TERMS)} OR {among(first, (*L.SENTENCE_STARTERS, *L.TECH_BAD_STARTERS))} OR {some(w, among(bare('w'), L.VERBS))} OR (len({w}) > 1 AND NOT {technical}))"
    long = f"list_transform(list_filter({w}, lambda w: length(w) > 3), lambda w: {strip_of('lower(w)', '.,;:!?')})"
    bad_service = f"(len({w}) > 5 OR {among('lower(x)', (*L.GENERIC_TERMS, *L.FAKE_SERVICES))} OR {among(f'lower({w}[1])', L.SENTENCE_STARTERS)} OR {some(w, among(bare('w'), L.VERBS))})"
    near = f"(len({long}) = 0 OR len(list_filter({long}, lambda w: contains(low, w))) >= greatest(1, len({long}) // 2))"
    use = f"(len({w}) BETWEEN 2 AND 6 AND NOT {_any(L.VAGUE_USE_CASES, 'x')} AND NOT {some(w, among(bare('w'), L.VERBS))})"
    like_product = f"(len({w}) > 0 AND regexp_matches({w}[1], '^[A-Z]') AND {among(f'lower({w}[-1])', L.PRODUCT_INDICATORS)})"
    return f"""WITH i AS (SELECT v.*, coalesce(t.text, '') AS text, lower(coalesce(t.text, '')) AS low FROM {dealt(C.ITEMS, 'p, t, s, u', 'doc_id, p, t, s, u')} v JOIN {_TEXTS} t USING (doc_id)),
      f AS (SELECT *, list_filter({_clean_items('p')}, lambda x: NOT {bad} AND {grounded}) AS pp, list_filter({_clean_items('t')}, lambda x: {among('lower(x)', known)} OR NOT {bad_tech}) AS tt,
        list_filter({_clean_items('s')}, lambda x: NOT {bad_service} AND {near}) AS ss, list_filter(list_transform({_clean_items('u')}, lambda x: lower(x)), lambda x: {use}) AS uu FROM i)
      SELECT doc_id, {csv(good_products)} AS products, {csv(distinct('tt'))} AS technologies, {csv(distinct('ss'))} AS services, {csv(distinct('uu'))} AS use_cases,
        {csv(f'list_filter(s, lambda x: {like_product})')} AS rescued, {csv(f'list_filter(s, lambda x: NOT {like_product})')} AS rest, {csv('list_filter(p, lambda x: contains(low, lower(x)))')} AS grounded FROM f"""


def _industries() -> str:
    probe = "(array_to_string(list_transform(t, lambda x: lower(x)), ' ') || ' ' || left(low, 800))"
    cases_ = " ".join(f"WHEN {hits(signals, 'probe')} >= {least} THEN {q(name)}" for signals, name, least in L.INDUSTRY_OVERRIDES)
    key = f"list_transform(list_filter({words('label')}, lambda w: length(w) > 4), lambda w: lower(w))"
    doubtful = f"(label <> '' AND (len({words('label')}) > 4 OR (len({key}) > 0 AND NOT {some(key, 'contains(low, w)')})))"
    return f"""WITH src AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM {_TEXTS}), {label_table('ind', 'src', L.INDUSTRY_SIGNALS, False)},
      l AS (SELECT v.doc_id, v.label, low, {probe} AS probe, coalesce(b.label, '') AS inferred FROM {dealt(C.LABELS, 'label, t', 'doc_id, label, t')} v JOIN src USING (doc_id) LEFT JOIN {best('ind')} b ON b.doc_id = v.doc_id)
      SELECT doc_id, label, CASE {cases_} WHEN {doubtful} AND inferred <> '' THEN inferred WHEN label <> '' THEN label ELSE inferred END AS industry FROM l"""


def _replies() -> str:
    items = ", ".join(f"CASE WHEN j IS NOT NULL THEN {csv(f"CAST(json_extract(j, '$.{c}') AS VARCHAR[])")} END AS {c}" for c in ("products", "technologies", "use_cases"))
    source_reply = """p_partkey AS doc_id, replace(replace(reply, '"A"', '"' || p_name || '"'), 'Mining', p_name) AS reply"""
    body = "regexp_extract(regexp_replace(reply, '```(?:json)?', '', 'g'), '(?s)(\\{.*\\})', 1)"
    return f"""WITH r AS (SELECT doc_id, {body} AS b FROM {dealt(C.REPLIES, 'reply', source_reply, 'part', 'p_partkey')}), o AS (SELECT doc_id, CASE WHEN coalesce(b, '') <> '' AND json_valid(b) THEN b::JSON END AS j FROM r)
      SELECT doc_id, j IS NOT NULL AS ok, {items},
        CASE WHEN j IS NOT NULL THEN coalesce(CASE WHEN json_type(j, '$.industry') = 'ARRAY' THEN json_extract_string(j, '$.industry[0]') ELSE json_extract_string(j, '$.industry') END, '') END AS industry FROM o"""


def _confidence() -> str:
    source_numbers = "doc_id, doc_id % 8 AS named, doc_id * 7 % 10 AS p, t, industry, doc_id % 7 AS u, length(coalesce(text, '')) AS n"
    raw = f"{ratio('named', 3, '0.28')} + {ratio('p', 5, '0.07')} + {ratio(specific('t'), 4, '0.22')} + {ratio('len(t)', 6, '0.10')} + CASE WHEN industry <> '' THEN 0.12 ELSE 0 END + {ratio('u', 3, '0.11')} + CASE WHEN n >= 2000 THEN 0.10 WHEN n >= 1000 THEN 0.06 WHEN n >= 500 THEN 0.03 ELSE 0 END"
    return f"SELECT doc_id, CAST(round(least({raw}, 1), 2) AS DOUBLE) AS extracted, {fallback_confidence('t', 'industry', 'u')} AS fallback FROM {dealt([(i, t, ind) for i, _, _, t, ind, _, _ in C.PROFILES], 't, industry', source_numbers)}"


def _links() -> str:
    from .sql import _HREF

    rest = "substr(link, 2)"
    hrefs = f"""(SELECT base, [link, {rest}, '../' || {rest}, './a/../' || {rest}, '?r=' || {rest}, '#' || {rest}, '//b.example' || link, 'mailto:' || {rest}][(k + length(base)) % 8 + 1] AS href FROM (
      SELECT url AS base, trim(unnest(hs)) AS link, unnest(range(len(hs))) AS k FROM (SELECT url, regexp_extract_all(coalesce(html, ''), '{_HREF}', 1) AS hs FROM pages)))"""
    root = "regexp_extract(base, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*')"
    page = "regexp_replace(base, '(?s)[?#].*$', '')"
    folder = f"({root} || CASE WHEN {page} = {root} THEN '/' ELSE regexp_replace(substr({page}, length({root}) + 1), '[^/]*$', '') END)"
    parts = "string_split(regexp_replace(regexp_replace(w, '(?s)[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '/')"
    kept = f"list_reduce(list_transform({parts}, lambda p: [p]), lambda acc, p: CASE WHEN p[1] = '.' THEN acc WHEN p[1] = '..' THEN CASE WHEN len(acc) > 1 THEN acc[1:-2] ELSE acc END ELSE acc || p END, []::VARCHAR[])"
    return f"""WITH l AS (SELECT base, href, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(base, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) || href
        WHEN starts_with(href, '/') THEN {root} || href WHEN starts_with(href, '?') THEN {page} || href WHEN starts_with(href, '#') THEN regexp_replace(base, '(?s)#.*$', '') || href ELSE {folder} || href END AS w FROM {hrefs})
      SELECT base, href, CASE WHEN contains(w, '/.') AND contains(w, '://') THEN regexp_extract(w, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*') || array_to_string({kept}, '/') || CASE WHEN {parts}[-1] IN ('.', '..') THEN '/' ELSE '' END || regexp_extract(w, '(?s)[?#].*$') ELSE w END AS url FROM l"""


def _strings() -> str:
    s = "coalesce(s, '')"
    parts = split(s, "(?i)[,;]\\s*|\\s+and\\s+")
    number = f"coalesce(TRY_CAST({strip(s)} AS DOUBLE), 0.0)"
    number = f"CASE WHEN isnan({number}) OR isinf({number}) THEN 0.0 ELSE {number} END"
    value = strip(s)
    bad = f"({value} = '' OR len({words(value)}) > 5 OR {among(f'lower({words(value)}[1])', L.SENTENCE_STARTERS)})"
    return f"""SELECT id, coalesce({parts}[1], '') AS name, {csv(f'{parts}[2:]')} AS features, {csv(split(s, '[,;]\\s*|\\.\\s+') + '[1:8]')} AS specs, CASE WHEN s IS NULL THEN '' ELSE {csv(parts + '[1:12]')} END AS technologies,
      coalesce(nullif({value}, ''), 'none') AS safe, printf('%.1f%%', {number}) AS percent, CASE WHEN {bad} THEN '' ELSE {value} END AS clean, CASE WHEN {value} = '' OR regexp_matches({value}, '[.!?]$') THEN {value} ELSE {value} || '.' END AS stopped,
      {csv(split(s, ','))} AS split FROM {_STRINGS}"""


def _lists() -> str:
    w = words("coalesce(s, '')")
    fold = "list_filter(w, lambda x, i: list_position(list_transform(w, lambda y: lower(y)), lower(x)) = i)"
    parts = split("(coalesce(s, '') || ', ' || coalesce(s, ''))", "[,;]\\s*")
    joined = "list_filter(c, lambda x, i: list_position(list_transform(c, lambda y: lower(y)), lower(x)) = i)"
    return f"""SELECT id, {csv(distinct('(w[1:2] || w)') + '[1:4]')} AS appended, {csv("list_filter(w, lambda x: lower(x) NOT IN ('and', 'the', 'one'))")} AS without, {csv(fold)} AS distinct, coalesce(array_to_string({joined}, ', '), '') AS collapsed
      FROM (SELECT id, {w} AS w, {parts} AS c FROM {_STRINGS})"""


def _outcomes() -> str:
    profile = keyword_profiles("pages").replace("WITH src", "src", 1)
    with_, select = profile.split("SELECT doc_id, coalesce(array_to_string(t[1:8]", 1)
    return f"""WITH r AS (SELECT doc_id, text FROM {_TEXTS}), pages AS (SELECT doc_id, trim(regexp_replace(repeat(text || ' ', CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 3 END), '\\s+', ' ', 'g')) AS text, repeat(text || ' ', CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 3 END) AS raw FROM r WHERE text IS NOT NULL AND doc_id % 11 <> 4),
      {with_}
      SELECT r.doc_id AS ord, CASE WHEN raw IS NULL THEN 'crawl_error' WHEN length(raw) < 800 THEN 'too_short' ELSE '' END AS skip_reason FROM r LEFT JOIN pages USING (doc_id)"""


def _record_parts() -> dict[str, str]:
    """SQL of the parts of product records, over (id, text, low) rows."""
    norm = lambda x: strip_of(f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))", " ,.;:-")
    tokens = "regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z0-9-]+')"
    term = lambda x: among(f"lower({x})", L.PRODUCT_TERMS)
    pairs = f"flatten(list_transform(range(1, greatest(len(k), 1)), lambda i: (CASE WHEN {term('k[i + 1]')} THEN [k[i] || ' ' || k[i + 1]] ELSE [] END) || (CASE WHEN {term('k[i]')} THEN [k[i]] ELSE [] END)))"
    low_tokens = "list_transform(regexp_extract_all(x, '[A-Za-z0-9-]+'), lambda y: lower(y))"
    good = f"(len({low_tokens}) > 0 AND {low_tokens}[1] NOT IN ('the', 'this', 'that', 'these', 'those', 'it') AND NOT {every(low_tokens, among('w', ('solution', 'system', 'platform')))})"
    fold = lambda l: f"list_filter({l}, lambda x, i: list_position(list_transform({l}, lambda y: lower(y)), lower(x)) = i)"  # noqa: E731, E741
    title = "array_to_string(list_transform(regexp_extract_all(x, '[A-Za-z0-9&+\\-]+'), lambda y: CASE WHEN y = upper(y) AND y <> lower(y) THEN y ELSE upper(y[1]) || lower(y[2:]) END), ' ')"
    tech = " || ".join(f"CASE WHEN contains(low, {q(t)}) THEN [{q('AI' if t == 'ai' else t.title())}] ELSE [] END" for t in L.RECORD_TECH_TERMS)
    lines = f"list_filter({split(_T, '[\\n•]')}, lambda s: length(s) BETWEEN 15 AND 130)"
    phrase = "[A-Z][A-Za-z0-9][A-Za-z0-9\\-]*(?:\\s+[A-Z][A-Za-z0-9][A-Za-z0-9\\-]*){0,4}"
    verbs = "platform|solution|software|system|suite|tool|product|service|app|api|sdk|is|are|enables|helps|allows|provides|offers|delivers|powers|automates"
    one = f"regexp_extract_all(coalesce(text, ''), {q(f'\\b({phrase})\\s+(?:(?:{verbs})\\b)')}, 1)"
    two = f"regexp_extract_all(coalesce(text, ''), {q(f'(?:[Oo]ur|[Mm]eet|[Ii]ntroducing|[Pp]resenting|[Ll]aunch(?:ing)?)\\s+({phrase})')}, 1)"
    lead = "|".join(L.LEADING_WORDS)
    hits_ = f"""list_transform({one}, lambda x: array_to_string({words(f"regexp_replace(x, '^(?:(?:{lead})(?:\\s+|$))+', '')")}, ' ')) || list_transform({two}, lambda x: {strip('x')})"""
    like = f"(len({words('x')}) >= 2 OR regexp_full_match(x, '[A-Z0-9\\-]*[A-Z][A-Z0-9\\-]*') OR regexp_matches(x, '^[A-Z].*[A-Z]'))"
    hit_list = f"list_filter({hits_}, lambda x: length(x) BETWEEN 4 AND 60 AND NOT {among('lower(x)', L.GENERIC_SINGLE)} AND {like})"
    head_words = f"{words('s')}[1:8]"
    stop = f"list_filter(range(1, 9), lambda i: {among(f'''regexp_replace(lower(({head_words})[i]), '[.,;:]+$', '')''', L.NAME_STOP)})[1]"
    head = strip_of(f"array_to_string(({head_words})[1:coalesce({stop} - 1, 8)], ' ')", " \\-|,;:.!?")
    heads = f"list_filter(list_transform(list_filter({_S}, lambda s: {_any(L.HYBRID_PRODUCT_HINTS, 'lower(s)')} AND NOT regexp_matches(lower(s), {q('^(?:' + '|'.join(L.SKIP_PREFIXES) + ')')})), lambda s: {head}), lambda p: length(p) BETWEEN 6 AND 60)"
    # Named products: sentences of one line, their names, and specifications from the sentence and its neighbours.
    spec_text = lambda x, w=20, n=140: strip_of(f"left({strip_of(f'array_to_string({words(x)}[1:{w}], {q(chr(32))})', ' ,.;:-')}, {n})", " ,.;:-")
    sentence = f"list_filter(list_transform(string_split(regexp_replace({_T}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {strip('x')}), lambda x: x <> '')"
    name = "\\b([A-Z][A-Za-z0-9&+\\-]*(?:\\s+[A-Z][A-Za-z0-9&+\\-]*)*)\\b"
    name_tokens = "regexp_extract_all(name, '[A-Za-z0-9&+\\-]+')"
    plausible = f"(name NOT IN ('It', 'Its', 'This', 'That', 'These', 'Those', 'The') AND length(name) BETWEEN 3 AND 60 AND len({name_tokens}) BETWEEN 2 AND 6 AND {some(name_tokens, '''regexp_matches(w, '^[A-Z]')''')} AND NOT {every(name_tokens, among('lower(w)', L.GENERIC_PRODUCT_TOKENS))})"
    near = lambda x: f"CASE WHEN {_any(L.SPEC_HINTS, f'lower({x})')} OR regexp_matches(lower({x}), '^(?:it |it\\.|this |these )') THEN {spec_text(x)} ELSE '' END"
    rest = strip_of("CASE WHEN contains(s, name) THEN left(s, instr(s, name) - 1) || substr(s, instr(s, name) + length(name)) ELSE s END", " ,.;:-")
    hinted = lambda words_: f"list_filter(l, lambda s: {_any(words_, 'lower(s)')})"
    named_ctes = f"""n AS (SELECT id, i, ss[i] AS s, CASE WHEN i > 1 THEN ss[i - 1] ELSE '' END AS before, coalesce(ss[i + 1], '') AS after FROM (SELECT id, ss, unnest(range(1, len(ss) + 1)) AS i FROM src)),
      m AS (SELECT *, {norm('raw')} AS name FROM (SELECT *, unnest(regexp_extract_all(s, {q(name)}, 1)) AS raw, generate_subscripts(regexp_extract_all(s, {q(name)}, 1), 1) AS j FROM n WHERE {_any(L.PRODUCT_SENTENCE_WORDS, 'lower(s)')})),
      o AS (SELECT id, i, j, name, {rest} AS rest, {near(norm('after'))} AS a, {near(norm('before'))} AS b FROM m WHERE {plausible}),
      e AS (SELECT id, i, j, name, CASE WHEN {_any(L.SPEC_HINTS, 'lower(rest)')} THEN {spec_text('rest')} ELSE '' END AS own, CASE WHEN a <> '' THEN a ELSE b END AS near FROM o),
      g AS (SELECT id, i, j, name, {spec_text("CASE WHEN own <> '' AND near <> '' AND lower(own) <> lower(near) THEN own || ', ' || near WHEN own <> '' THEN own ELSE near END", 26, 180)} AS spec FROM e),
      h AS (SELECT * FROM (SELECT * FROM g WHERE spec <> '' QUALIFY row_number() OVER (PARTITION BY id, lower(name), lower(spec) ORDER BY i, j) = 1) QUALIFY row_number() OVER (PARTITION BY id ORDER BY i, j) <= 6)"""
    return {
        "tokens": tokens, "sentences": sentence, "lines": lines, "hits": hit_list, "plausible": plausible, "named": named_ctes,
        "bigrams": f"{fold(f'list_filter({pairs}, lambda x: {good})')}[1:5]", "titled": f"list_filter(list_transform(bg, lambda x: {title}), lambda t: len(string_split(t, ' ')) BETWEEN 2 AND 6)[1:6]",
        "technologies": f"array_to_string({tech}, ', ')", "specs": distinct(f"(CASE WHEN len({hinted(L.HYBRID_SPEC_HINTS)}) > 0 THEN {hinted(L.HYBRID_SPEC_HINTS)} ELSE {hinted(L.HYBRID_SPEC_VERBS)} END)") + "[1:5]",
        "patterns": distinct(f"(CASE WHEN len(hit) > 0 THEN hit ELSE {heads} END)") + "[1:5]",
    }


def _product_records() -> str:
    p = _record_parts()
    return f"""WITH src AS (SELECT id, text, lower(coalesce(text, '')) AS low, {p['tokens']} AS k, {p['sentences']} AS ss FROM (SELECT doc_id AS id, text FROM {_TEXTS})), {p['named']},
      z AS (SELECT id, string_agg(name || ':' || spec, '|' ORDER BY i, j) AS named FROM h GROUP BY 1), b AS (SELECT id, text, low, {p['bigrams']} AS bg, {p['lines']} AS l, {p['hits']} AS hit FROM src)
      SELECT b.id, coalesce(named, '') AS named, {csv('bg')} AS bigrams, {csv(p['titled'])} AS titled, coalesce({p['technologies']}, '') AS technologies, {csv(p['specs'])} AS lines, {csv(p['patterns'])} AS patterns FROM b LEFT JOIN z USING (id)"""


def company_records() -> str:
    """Company records of documents; the source is the company."""
    from .sql import _SIG

    p = _record_parts()
    tidy = f"list_filter(list_transform({_S}, lambda x: regexp_replace(regexp_replace(x, '\\s+', ' ', 'g'), '^[ ,.;:-]+|[ ,.;:-]+$', '', 'g')), lambda x: x <> '' AND len(string_split(x, ' ')) <= 22)"
    first_words = f"array_to_string({words('spec')}[1:20], ' ')"
    spec = strip_of(f"left({strip_of(first_words, ' ,.;:-')}, 140)", " ,.;:-")
    parts = split(spec, "[,;]\\s*")
    collapsed = "array_to_string(list_filter(c, lambda x, i: list_position(list_transform(c, lambda y: lower(y)), lower(x)) = i), ', ')"
    same_line = f"list_filter(list_transform(string_split(regexp_replace(body, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {strip('x')}), lambda x: x <> '')"
    lines = f"list_filter(list_transform(string_split_regex(body, '\\r\\n|[\\n\\r]'), lambda x: {strip('x')}), lambda x: x <> '')"
    industry = "CASE " + " ".join(f"WHEN contains(low, {q(w)}) THEN {q(g)}" for w, g in L.FIRST_MATCH_INDUSTRIES) + " END"
    bucket = f"CASE WHEN {_any(('enterprise', 'premium', 'high-end'), 'low')} THEN 'High-end' WHEN {_any(('affordable', 'low cost', 'budget'), 'low')} THEN 'Budget' WHEN {_any(('$', 'pricing', 'quote'), 'low')} THEN 'Quoted' END"
    return f"""WITH d AS (SELECT doc_id AS id, source, {_T} AS body, list_filter({_S}, lambda x: {_any(L.SECTION_WORDS, 'lower(x)')})[1:80] AS sec FROM documents),
      x AS (SELECT id, CASE WHEN len(sec) > 0 THEN array_to_string(sec, ' ') ELSE body END AS text FROM d), y AS (SELECT id, {tidy} AS l FROM x),
      v AS (SELECT id, coalesce(array_to_string(list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: {_SIG.format('y', 10)}), {_SIG.format('x', 10)}) = i)[1:4], chr(10)), '') AS text FROM y),
      src AS (SELECT id, text, {p['sentences']} AS ss FROM v), {p['named']}, z AS (SELECT id, list({{'name': name, 'spec': spec}} ORDER BY i, j) AS items FROM h GROUP BY 1),
      kk AS (SELECT id, {p['tokens']} AS k FROM (SELECT id, body AS text FROM d)), bb AS (SELECT id, {p['bigrams']} AS bg FROM kk), tt AS (SELECT id, list_transform({p['titled']}, lambda t: {{'name': t, 'spec': ''}}) AS items FROM bb),
      u AS (SELECT id, unnest(coalesce(z.items, tt.items)) AS it, generate_subscripts(coalesce(z.items, tt.items), 1) AS pos FROM tt LEFT JOIN z USING (id)),
      f AS (SELECT id, pos, {strip_of("trim(regexp_replace(it.name, '\\s+', ' ', 'g'))", ' ,.;:-')} AS name, it.spec AS spec FROM u),
      g2 AS (SELECT id, pos, name, {collapsed} AS spec FROM (SELECT *, {parts} AS c FROM f) WHERE {p['plausible']}),
      g3 AS (SELECT * FROM (SELECT * FROM g2 QUALIFY row_number() OVER (PARTITION BY id, lower(name) ORDER BY pos) = 1) QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) <= 6),
      g4 AS (SELECT id, '[' || string_agg('{{"name":' || to_json(name) || ',"specifications":' || to_json(coalesce(spec, '')) || '}}', ',' ORDER BY pos) || ']' AS products, list(spec ORDER BY pos) FILTER (coalesce(spec, '') <> '') AS specs FROM g3 GROUP BY 1),
      r AS (SELECT d.*, lower(body) AS low, {same_line} AS s, {lines} AS lines, products, specs[1:5] AS c FROM d LEFT JOIN g4 USING (id))
      SELECT nullif(source, '') AS company_name, CAST(id AS VARCHAR) AS website, {industry} AS industry, products, nullif({p['technologies']}, '') AS technologies,
        coalesce(nullif({collapsed}, ''), left(list_filter(s, lambda x: {_any(L.SPEC_SENTENCE_WORDS, 'lower(x)')})[1], 240)) AS product_specifications, {bucket} AS price_range,
        nullif(regexp_extract(body, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}'), '') AS contact_email, nullif(trim(regexp_extract(body, '\\+?[0-9][0-9\\s().-]{{7,}}[0-9]')), '') AS phone,
        left(list_filter(lines, lambda x: {_any(L.ADDRESS_HINTS, 'lower(x)')} AND regexp_matches(x, '[0-9]'))[1], 200) AS address,
        nullif(left(array_to_string(list_filter(s, lambda x: len({words('x')}) >= 6)[1:2], ' '), 500), '') AS description FROM r"""


def mixed_profiles() -> str:
    p = _record_parts()
    kept = f"trim(regexp_replace(array_to_string(list_filter({_S}, lambda x: length(x) >= 40)[1:3], ' '), '\\s+', ' ', 'g'))"
    fast = f"CASE WHEN {kept} = '' THEN '' ELSE regexp_replace(left({kept}, 320), '[ ,;:]+$', '') || '.' END"
    longer = f"CASE WHEN array_to_string(list_filter({_S}, lambda x: length(x) >= 40)[1:3], ' ') <> '' THEN regexp_replace(left(array_to_string(list_filter({_S}, lambda x: length(x) >= 40)[1:3], ' '), 320), '[ ,;:]+$', '') ELSE {strip("regexp_replace(left(text, 320), ' [^ ]*$', '')")} END"
    return f"""WITH src AS (SELECT doc_id, {strip(_T)} AS text FROM documents), b AS (SELECT doc_id, text, {p['lines']} AS l, {p['hits']} AS hit, {fast} AS fast, {longer} AS longer FROM src),
      c AS (SELECT doc_id, {p['patterns']} AS products, {p['specs']} AS specs, longer, CASE WHEN length({strip('fast')}) >= 140 THEN 'high' WHEN length({strip('fast')}) >= 45 THEN 'medium' ELSE 'low' END AS first FROM b)
      SELECT doc_id, coalesce(array_to_string(products, ','), '') AS products, CAST(len(specs) AS INT) AS n_specs, CASE WHEN (first = 'low' OR (len(products) = 0 AND len(specs) = 0)) AND longer <> '' THEN 'medium' ELSE first END AS summary_confidence FROM c"""


def frontier(test_links, pages: str = "pages") -> str:
    """Two rounds of links: those of the root, then those of the second address."""
    from .sql import _HREF, _score_case

    score = _score_case(test_links["hints"], "contains(lower(full_url), {0})", 10) + " + " + _score_case(test_links["keywords"], "(contains(lower(full_url), {0}) OR contains(lower(anchor), {0}))", 5)
    normal = "regexp_replace(regexp_replace({0}, '(?s)[?#].*$', ''), '/+$', '')"

    def linked(source: str) -> str:
        return f"""SELECT site, full_url, row_number() OVER (PARTITION BY site ORDER BY score DESC, k) AS rank FROM (
          SELECT site, full_url, max({score}) AS score, min(k) AS k FROM (SELECT site, k, {normal.format("regexp_extract(url, '^[a-z]+://[^/?#]*') || trim(href)")} AS full_url, anchor FROM (
            SELECT site, url, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS href, unnest(regexp_extract_all(html, '{_HREF}', 2)) AS anchor, unnest(range(len(regexp_extract_all(html, '{_HREF}', 1)))) AS k FROM {source}) WHERE starts_with(trim(href), '/'))
          WHERE NOT contains(lower(full_url), 'privacy') AND ({score}) > 0 GROUP BY 1, 2) QUALIFY rank <= 6"""

    root = "regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)"
    return f"""WITH t AS (SELECT u AS url, min(html) AS html FROM (SELECT {normal.format('url')} AS u, html FROM {pages} UNION ALL SELECT {root}, html FROM {pages}) WHERE u <> '' GROUP BY 1),
      s AS (SELECT DISTINCT {root} AS site FROM {pages} WHERE {root} <> ''), one AS (SELECT site, t.url, html FROM s JOIN t ON t.url = site),
      q1 AS (SELECT site, site AS url, 0 AS pos FROM s UNION ALL SELECT site, full_url, rank FROM ({linked('one')}) WHERE full_url <> site),
      q2 AS (SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY pos) - 1 AS pos FROM q1), two AS (SELECT q2.site, q2.url, html FROM q2 JOIN t USING (url) WHERE pos = 1),
      q3 AS (SELECT site, url, pos FROM q2 UNION ALL SELECT site, full_url, 100 + rank FROM ({linked('two')}) l WHERE NOT EXISTS (SELECT 1 FROM q2 WHERE q2.site = l.site AND q2.url = l.full_url)),
      q4 AS (SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY pos) - 1 AS pos FROM q3)
      SELECT site AS website, CAST(pos AS INT) AS "at", q4.url FROM q4 JOIN t USING (url) WHERE pos < 8"""


def _letters(text: str) -> str:
    return f"list_transform(string_split('a,b,c,d,e,f,g,h,i,j,k,l,m,n,o,p,q,r,s,t,u,v,w,x,y,z', ','), lambda c: (length({text}) - length(replace(lower({text}), c, '')))::DOUBLE)"


def _classifier() -> str:
    table = "(VALUES " + ", ".join(f"({i}, {q(n)}, {q(t)}, {lit(w)})" for i, (n, t, w) in enumerate(L.CLASSIFIER)) + ") r(o, label, about, hints)"
    return f"""WITH v AS (SELECT doc_id, {_T} AS t, {_letters(_T)} AS v FROM documents), r AS (SELECT o, label, hints, {_letters('about')} AS w FROM {table}),
      s AS (SELECT doc_id, t, o, label, CASE WHEN list_sum(v) = 0 THEN 0 ELSE list_cosine_similarity(v, w) END + 0.03 * len(list_filter(hints, lambda h: contains(lower(t), h))) AS score FROM v, r)
      SELECT doc_id, CASE WHEN {strip('t')} = '' THEN 'Other' ELSE label END AS industry, CASE WHEN {strip('t')} = '' THEN 0.0 ELSE round(round(greatest(least(score, 1.0), 0.0), 4), 3) END AS confidence
      FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, o) = 1"""


def _ranked_profiles() -> str:
    lex = L.TEST_LEXICON
    least = lambda a, b, strong, medium, low: f"least({a} * ({hits(lex[strong], low)}) + {b} * ({hits(lex[medium], low)}), 100)"
    weights = ", ".join(f"CASE WHEN contains(body, {q(w)}) THEN {n} ELSE 0 END" for w, n in lex["use_cases"].items())
    return f"""WITH p AS (SELECT doc_id, lower(' ' || text) AS body, lower(' ' || text || ' ' || source || ' ') AS wide FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
      r AS (SELECT d.doc_id, coalesce(body, ' ') AS body, coalesce(wide, '   ') AS wide, p.doc_id IS NOT NULL AS have FROM documents d LEFT JOIN p USING (doc_id)),
      f AS (SELECT doc_id, have, CAST({least(28, 10, 'domain_strong', 'domain_medium', 'wide')} * 0.35 AS DECIMAL(8,2)) AS dom, CAST({least(25, 10, 'product_strong', 'product_medium', 'body')} * 0.25 AS DECIMAL(8,2)) AS pro,
        CAST({least(22, 8, 'ai_strong', 'ai_medium', 'body')} * 0.20 AS DECIMAL(8,2)) AS ai, CAST(greatest(0, {weights}) * 0.20 AS DECIMAL(8,2)) AS use FROM r),
      s AS (SELECT *, greatest(least(CAST(least(dom + pro + ai + use, 100) * CASE WHEN have THEN 0.70 ELSE 1.00 END - CASE WHEN have THEN 5 ELSE 0 END AS DECIMAL(10,2)), 100), 0) AS total FROM f)
      SELECT doc_id AS ord, CAST(total AS DOUBLE) AS score, CASE WHEN total >= 75 THEN 'High Potential' WHEN total >= 55 THEN 'Good Potential' WHEN total >= 35 THEN 'Moderate' ELSE 'Low Potential' END AS category, CAST(ai AS DOUBLE) AS ai, CAST(dom AS DOUBLE) AS domain FROM s"""


def _budget() -> str:
    named = r"\b[A-Z][a-z]+(?:[A-Z][a-z]*)+\b|\b[A-Z]{2,}[0-9]+\b|\b[A-Z][a-z]+ [A-Z][a-z]+\b"
    return f"""WITH s AS (SELECT doc_id, unnest({_S}) AS s, generate_subscripts({_S}, 1) AS i FROM documents),
      k AS (SELECT *, CASE WHEN regexp_matches(s, {q(named)}) THEN 0 WHEN {_any(L.RELEVANT_WORDS, 'lower(s)')} THEN 1 ELSE 2 END AS kind FROM s),
      b AS (SELECT *, 900 - coalesce(sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY kind, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM k),
      j AS (SELECT doc_id, {strip("string_agg(left(s, room::INT), ' ' ORDER BY kind, i)")} AS j FROM b WHERE room > 0 GROUP BY 1)
      SELECT d.doc_id, CAST(length(left(CASE WHEN length(coalesce(j, '')) < 150 THEN left({_T}, 900) ELSE j END, 900)) AS INT) AS n FROM documents d LEFT JOIN j USING (doc_id)"""


def _summaries(source: str) -> str:
    """(doc_id, t, summary): the first sentences of some length, or the opening."""
    clean = f"list_transform(list_filter({_S}, lambda x: length(x) >= 40)[1:3], lambda x: x)"
    opening = "regexp_extract(left(t, 300), '(?s)^(.*\\.)', 1)"
    return f"""SELECT doc_id, t, CASE WHEN length(main) >= 50 THEN main WHEN length(opening) > 40 THEN opening ELSE '' END AS summary FROM (
      SELECT doc_id, t, CASE WHEN c <> '' THEN regexp_replace(left(c, 350), '[ ,;:]+$', '') ELSE {strip("regexp_replace(left(t, 350), ' [^ ]*$', '')")} END AS main, {strip(f"CASE WHEN {opening} <> '' THEN {opening} ELSE left(t, 300) END")} AS opening
      FROM (SELECT doc_id, {_T} AS t, array_to_string({clean}, ' ') AS c FROM {source}))"""


def _rank_pipeline() -> str:
    """Sources as companies, ranked by the keyword profiles of their merged texts under the test lexicon."""
    from .sql import _CLEAN, _SIG

    lex = L.TEST_LEXICON
    merged = f"""WITH c AS (SELECT doc_id, source, {_CLEAN.format(_T)} AS text FROM documents), s AS (SELECT source, doc_id, unnest({_S}) AS s, generate_subscripts({_S}, 1) AS p FROM c),
      k AS (SELECT *, {_SIG.format('s', 14)} AS sig FROM s WHERE length(s) >= 40), u AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY source, sig ORDER BY doc_id, p) = 1),
      b AS (SELECT *, coalesce(sum(length(s) + 1) OVER (PARTITION BY source ORDER BY doc_id, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u)
      SELECT source AS doc_id, trim(left(string_agg(s, ' ' ORDER BY doc_id, p), 2800)) AS text FROM b WHERE before < 2801 GROUP BY 1 HAVING length(left(string_agg(s, ' ' ORDER BY doc_id, p), 2800)) >= 800"""
    points = lambda a, b, strong, medium, low: f"{a} * ({hits(lex[strong], low)}) + {b} * ({hits(lex[medium], low)})"
    weights = ", ".join(f"CASE WHEN contains(used, {q(w)}) THEN {n} ELSE 0 END" for w, n in lex["use_cases"].items())
    bonus = "least(8 * len(list_filter(string_split(products, ','), lambda x: length(x) > 3)), 24)"
    share = lambda x, w, name: f"CAST(least({x}, 100) * {w} AS DECIMAL(8,2)) AS {name}"
    return f"""WITH merged AS ({merged}), o AS (SELECT source AS doc_id, min(doc_id) AS ord FROM documents GROUP BY 1),
      p AS ({keyword_profiles('merged')}), z AS ({_summaries('merged')}),
      a AS (SELECT o.ord, p.*, replace(use_cases, ',', ' ') AS uses, lower(summary || ' ' || t) AS body, CASE WHEN length(t) >= 1000 THEN 'GOOD' ELSE 'LOW' END AS flag FROM p JOIN z USING (doc_id) JOIN o USING (doc_id)),
      w AS (SELECT *, body || ' ' || lower(industry) || ' ' || lower(uses) AS wide, body || ' ' || lower(replace(products, ',', ' ')) || ' ' AS made, body || ' ' || lower(replace(technologies, ',', ' ')) AS tech, body || ' ' || lower(uses) AS used FROM a),
      f AS (SELECT *, {share(points(28, 10, 'domain_strong', 'domain_medium', 'wide'), 0.35, 'dom')}, {share(points(25, 10, 'product_strong', 'product_medium', 'made') + ' + ' + bonus, 0.25, 'pro')},
        {share(points(22, 8, 'ai_strong', 'ai_medium', 'tech'), '0.20', 'ai')}, CAST(greatest(0, {weights}) * 0.20 AS DECIMAL(8,2)) AS use FROM w),
      g AS (SELECT *, greatest(least(CAST(least(dom + pro + ai + use, 100) * CASE WHEN flag = 'LOW' THEN 0.70 ELSE 1.00 END - CASE WHEN flag = 'LOW' OR confidence < 0.45 THEN 5 ELSE 0 END AS DECIMAL(10,2)), 100), 0) AS total FROM f),
      h AS (SELECT *, list_filter([CASE WHEN dom >= 12 THEN 'domain match (' || coalesce(nullif(industry, ''), 'target sector') || ')' END, CASE WHEN ai >= 8 THEN 'AI/vision capabilities' END,
        CASE WHEN use >= 8 THEN 'use case: ' || coalesce(nullif(string_split(use_cases, ',')[1], ''), 'aligned application') END, CASE WHEN use >= 10 THEN 'strong use-case alignment' END], lambda x: x IS NOT NULL) AS sig FROM g)
      SELECT ord, doc_id AS company_name, doc_id AS website, CAST(total AS DOUBLE) AS score, CASE WHEN total >= 75 THEN 'High Potential' WHEN total >= 55 THEN 'Good Potential' WHEN total >= 35 THEN 'Moderate' ELSE 'Low Potential' END AS category,
        industry, confidence, CASE WHEN len(sig) = 0 THEN {q(L.WEAK_REASON.format(target=L.TARGET))} ELSE {q(L.FIT_REASON.format(target=L.TARGET))} || array_to_string(sig, '; ') || ' (score ' || regexp_replace(printf('%.2f', CAST(total AS DOUBLE)), '(\\.[0-9])0$', '\\1') || ').' END AS reason FROM h"""


def headings() -> str:
    """Pages there have plain headings, and lists of links without further elements."""
    plain = "regexp_replace(y, '<[^>]*>', '', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        plain = f"replace({plain}, {q(entity)}, {q(char)})"
    inner = lambda tag: f"list_transform(regexp_extract_all(coalesce(html, ''), '(?s)<{tag}>(.*?)</{tag}>', 1), lambda y: {strip(plain)})"
    heads = f"list_filter({inner('h1')}, lambda t: length(t) > 15 AND length(t) < 120 AND NOT {_any(L.HEADING_BLACKLIST, 'lower(t)')})"
    items = f"list_filter({inner('li')}, lambda t: length(t) > 15 AND length(t) < 500)"
    return f"SELECT page_id, coalesce(array_to_string({heads}[1:10], ' '), '') AS headings, coalesce(array_to_string({items}[1:10], ' '), '') AS listed FROM pages"


def oracles(test_links) -> dict[str, str]:
    parsed = "CASE WHEN starts_with(trim(cell), '[') AND json_valid(cell) THEN 1 ELSE 0 END"
    return {
        "keyword_profiles": keyword_profiles("documents"),
        "relevant_budget": _budget(),
        "page_headings": headings(),
        "mixed_profiles": mixed_profiles(),
        "product_records": company_records(),
        "crawl_frontier": frontier(test_links),
        "case_keyword_profiles": keyword_profiles(_TEXTS),
        "case_technologies": f"SELECT doc_id, {csv(technologies("(' ' || lower(coalesce(text, '')) || ' ')", 'existing'))} AS technologies FROM {_TEXTS} JOIN {dealt(C.EXISTING.items(), 'existing', 'doc_id, existing')} USING (doc_id)",
        "case_clean_names": _clean_names(),
        "case_brand_tokens": f"SELECT DISTINCT word, {brand_token('word')} AS brand FROM (SELECT unnest({words(_T)}) AS word FROM {_TEXTS})",
        "case_industries": _industries(),
        "case_replies": _replies(),
        "case_confidence": _confidence(),
        "case_gates": f"SELECT p.doc_id, length({strip(_T)}) < 100 AS short, technologies = '' AND industry = '' AS hopeless FROM ({keyword_profiles(_TEXTS)}) p JOIN {_TEXTS} USING (doc_id)",
        "case_links": _links(),
        "case_roster": f"""SELECT n, trim(name) AS name, trim(site) AS website FROM {_ROSTER} WHERE trim(coalesce(name, '')) <> '' AND trim(coalesce(site, '')) <> ''
          QUALIFY row_number() OVER (PARTITION BY lower(trim(name)), string_split(regexp_replace(regexp_replace(lower(trim(site)), '^https?://', ''), '^www\\.', ''), '/')[1] ORDER BY n) = 1""",
        "case_product_cells": f"""WITH c AS (SELECT id, cell, {parsed} AS ok FROM {_CELLS}), l AS (SELECT id, CASE WHEN ok = 1 THEN list_filter(list_transform(CAST(cell AS JSON[]), lambda x: [{strip("coalesce(json_extract_string(x, '$.name'), '')")}, {strip("coalesce(json_extract_string(x, '$.specifications'), '')")}]), lambda y: y[1] <> '')
            ELSE list_transform({split("coalesce(cell, '')", ',')}, lambda y: [y, '']) END AS p FROM c)
          SELECT id, {csv("list_transform(p, lambda y: y[1] || ':' || y[2])")} AS products, CASE WHEN len(p) = 0 THEN '' ELSE '[' || array_to_string(list_transform(p, lambda y: '{{"name":' || to_json(y[1]) || ',"specifications":""}}'), ',') || ']' END AS json FROM l""",
        "case_strings": _strings(),
        "case_lists": _lists(),
        "case_product_records": _product_records(),
        "case_sandbox": f"""WITH w AS (SELECT DISTINCT {_DOMAIN.format('url')} AS website FROM pages), n AS (SELECT website, coalesce(nullif(website, ''), 'company.com') AS dom FROM w),
          k AS (SELECT website, dom, array_to_string(list_transform(string_split(replace(string_split(dom, '.')[1], '-', ' '), ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS name FROM n)
          SELECT website, md5(replace(replace({q(SANDBOX)}, '{{name}}', name), '{{domain}}', dom)) AS digest, name || ' Navigator system, ' || name || ' Inspector device.' AS products, 'GOOD' AS quality FROM k""",
        "case_outcomes": _outcomes(),
        "ranked_profiles": _ranked_profiles(),
        "summary_fallbacks": f"""WITH s AS ({_summaries('documents')}) SELECT doc_id, summary, CASE WHEN length({strip('summary')}) >= 140 THEN 'high' WHEN length({strip('summary')}) >= 45 THEN 'medium' ELSE 'low' END AS confidence,
            {strip_of(f'left({strip_of(f"array_to_string({words(chr(116))}[1:20], {q(chr(32))})", " ,.;:-")}, 140)', " ,.;:-")} AS spec FROM s""",
        "rank_pipeline": _rank_pipeline(),
        "cached_vectors": f"""WITH k AS (SELECT doc_id, left({strip(_T)}, 1200) AS cut FROM documents), h AS (SELECT doc_id, sha1(cut) AS key, length(cut)::DOUBLE AS n FROM k), c AS (SELECT DISTINCT key FROM h WHERE doc_id IN (SELECT doc_id FROM labels))
          SELECT doc_id, h.key, CASE WHEN c.key IS NULL THEN n ELSE -1.0 END AS value FROM h LEFT JOIN c ON h.key = c.key""",
        "letter_classifier": _classifier(),
        "digest_vector": f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all({_T}, '[a-zA-Z0-9]+')) AS tok FROM documents), b AS (SELECT doc_id, ('0x' || left(md5(lower(tok)), 4))::INT % 256 AS slot, count(*) AS n FROM t GROUP BY ALL),
          g AS (SELECT doc_id, i, coalesce(n, 0) AS n FROM (SELECT doc_id, unnest(range(0, 256)) AS i FROM documents) LEFT JOIN b USING (doc_id) WHERE false) SELECT doc_id, array_to_string(list_transform(range(0, 256), lambda i: coalesce(m[i], 0)), ',') AS vector
          FROM (SELECT d.doc_id, coalesce(m, MAP {{}}) AS m FROM documents d LEFT JOIN (SELECT doc_id, map_from_entries(list((slot, n))) AS m FROM b GROUP BY 1) USING (doc_id))""",
        "csv_results": """SELECT CASE WHEN s_acctbal > 0 THEN s_name ELSE 'Unknown Company' END AS company_name, 'site' || s_suppkey AS website, round(round(s_acctbal::DOUBLE, 4), 2) AS score, '[{"name":"' || s_name || '","specifications":""}]' AS products,
          CAST(round(s_nationkey::DOUBLE / 7, 4) AS VARCHAR) AS confidence, 'say "so", then' AS reason FROM supplier""",
        "json_results": """SELECT CASE WHEN s_acctbal > 0 THEN s_name ELSE 'Unknown' END AS company_name, 'site' || s_suppkey AS website, round(round(s_acctbal::DOUBLE, 4), 2) AS score, 'Low Potential' AS category, CASE WHEN s_nationkey > 12 THEN 'Trade' ELSE 'Other' END AS industry,
          s_name AS products, round(s_nationkey::DOUBLE / 7, 4) AS confidence, 'No summary available.' AS summary, 'say "so", then' AS reason FROM supplier""",
        "cache_upserts": "SELECT CAST(user_id AS VARCHAR) AS website_key, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
        "stale_pages": "SELECT ts IS NULL OR (SELECT max(ts) FROM events) > ts + INTERVAL 86400 SECOND AS stale, count(*) AS n FROM events GROUP BY 1",
        "dashboard_table": "SELECT s_name AS company_name, 'https://site' || s_suppkey AS website, s_acctbal::DOUBLE AS score, 'site' || s_suppkey AS label FROM supplier",
    }
