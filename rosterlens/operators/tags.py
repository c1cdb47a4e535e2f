"""Pages as tables of tags: one scan gives each element an interval, and what lies in it is containment.

The scan runs in Arrow batches, once for a page, and gives the page's text, the text outside of pruned elements, and
for each element its place in document order, the place of its last descendant, its depth, and where its text begins and ends
in both texts. All else (main part, sections, rows of tables, headings) is Column expressions over these intervals;
``tag_rows`` has them as rows for joins.
"""

from __future__ import annotations

import html as entities
import re
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..functions.arrays import let

#: Elements without an end tag, those whose content is no markup, and those that are no part of a page's main text. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))
PRUNED = frozenset("script style noscript nav footer svg iframe".split())
ATTRIBUTES = ("class", "id", "name", "property", "content", "href")

#: Pages that are Python objects at once.
PAGES = 16

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")
_NODE = "tag: string, pre: int, last: int, depth: int, children: int, shown_children: int, hidden: boolean, start: int, end: int, shown_start: int, shown_end: int, " + ", ".join(f"{a}: string" for a in ATTRIBUTES)
TAGS = f"struct<text: string, shown: string, nodes: array<struct<{_NODE}>>>"
_NAMES = [f.split(":")[0] for f in _NODE.split(", ")]


def _closed(text: str) -> str:
    """``text`` with the entities resolved that end with a semicolon; one that is cut off, as in ``AT&amp``, stays as it is."""
    return _CLOSED.sub(lambda m: entities.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], text)


def scan(page: str, cut_entities: bool = True) -> tuple[str, str, list[tuple]]:
    """A page's whole text, its text outside of pruned elements, and its elements in document order.

    An element ends at its own end tag, which closes what is still open inside, or with the page; an end tag without a
    beginning is passed over. Comments and declarations are no text. Old entities are also resolved without their semicolon,
    as browsers do, unless ``cut_entities`` is false.
    """
    resolved = entities.unescape if cut_entities else _closed
    text: list[str] = []
    shown: list[str] = []
    nodes: list[list] = []
    open_: list[int] = []
    size = out = pruned = at = 0

    def add(data: str) -> None:
        nonlocal size, out
        text.append(data)
        size += len(data)
        if not pruned:
            shown.append(data)
            out += len(data)

    def close(upto: int) -> None:
        nonlocal pruned
        while len(open_) > upto:
            node = nodes[open_.pop()]
            node[2], node[8], node[10] = len(nodes) - 1, size, out
            pruned -= node[0] in PRUNED

    while at < len(page):
        token = _TOKEN.search(page, at)
        begin = token.start() if token else len(page)
        if begin > at:
            add(resolved(page[at:begin]))
        if not token:
            break
        at = token.end()
        end_tag, tag = token[1], token[2]
        if end_tag:
            end_tag = end_tag.lower()
            found = next((i for i in range(len(open_) - 1, -1, -1) if nodes[open_[i]][0] == end_tag), None)
            if found is not None:
                close(found)
        elif tag:
            tag, inside = tag.lower(), token[3] or ""
            values: dict[str, str] = {}
            for name, *value in _ATTRIBUTE.findall(inside):
                name = name.lower()
                if name in ATTRIBUTES:
                    values[name] = resolved(next((v for v in value if v), ""))
            hidden = pruned > 0 or tag in PRUNED
            if open_:
                nodes[open_[-1]][4] += 1
                nodes[open_[-1]][5] += not hidden
            place = len(nodes)
            nodes.append([tag, place, place, len(open_), 0, 0, hidden, size, size, out, out, *(values.get(a) for a in ATTRIBUTES)])
            if tag in VOID or inside.rstrip().endswith("/"):
                continue
            open_.append(place)
            pruned += tag in PRUNED
            if tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                upto = stop.start() if stop else len(page)
                if upto > at:
                    add(page[at:upto])
                at = upto
    close(0)
    return "".join(text), "".join(shown), nodes


def tag_array(pages: pa.Array, cut_entities: bool = True) -> pa.Array:
    """Structs of ``TAGS``; elements are Python objects for ``PAGES`` pages at a time only, as a batch has many megabytes of markup."""
    kind = pa.struct([("text", pa.string()), ("shown", pa.string()), ("nodes", pa.list_(pa.struct([(n, pa.string() if n in ("tag", *ATTRIBUTES) else pa.bool_() if n == "hidden" else pa.int32()) for n in _NAMES])))])

    def some(column: pa.Array) -> pa.Array:
        rows = []
        for page in column.to_pylist():
            text, shown, nodes = scan(page or "", cut_entities)
            rows.append({"text": text, "shown": shown, "nodes": [dict(zip(_NAMES, n, strict=True)) for n in nodes]})
        return pa.array(rows, kind)

    parts = [some(pages.slice(a, PAGES)) for a in range(0, len(pages), PAGES)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def with_tags(pages: DataFrame, html_col: str = "html", name: str = "tags", cut_entities: bool = True) -> DataFrame:
    """``pages`` with a struct of both texts and the elements; a null page has empty ones."""

    @F.arrow_udf(TAGS)
    def cut(column: pa.Array) -> pa.Array:
        return tag_array(column, cut_entities)

    return pages.withColumn(name, cut(F.col(html_col)))


def tag_rows(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, tag, pre, last, depth, ..., text): one row for each element; ``b`` is inside ``a`` where a.pre < b.pre <= a.last."""
    rows = with_tags(pages.select(id_col, html_col), html_col, "__tags").select(id_col, F.col("__tags.text").alias("__text"), F.explode("__tags.nodes").alias("n"))
    return rows.select(id_col, "n.*", F.substring(F.col("__text"), F.col("n.start") + 1, F.col("n.end") - F.col("n.start")).alias("text")).drop("shown_start", "shown_end")


def inside(nodes: Column, outer: Column) -> Column:
    return F.filter(nodes, lambda n: (n["pre"] > outer["pre"]) & (n["pre"] <= outer["last"]))


def text_of(tags: Column, node: Column, shown: bool = False) -> Column:
    """An element's text, stripped; without pruned elements where ``shown``."""
    a, b = ("shown_start", "shown_end") if shown else ("start", "end")
    return T.strip(F.substring(tags["shown" if shown else "text"], node[a] + 1, node[b] - node[a]))


def _longer(texts: Column, least: int, most: int) -> Column:
    return F.filter(texts, lambda t: (F.length(t) > least) & (F.length(t) < most))


def main_text(tags: Column, most: int | None = 4000) -> Column:
    """Meta descriptions, headings and small blocks of the main part, all of them where ``most`` is null; a nested block repeats its text."""

    def of(nodes: Column) -> Column:
        first = lambda test: F.get(F.filter(nodes, test), F.lit(0))
        whole = F.struct(F.lit(-1).alias("pre"), F.lit((1 << 31) - 1).alias("last"))
        span = lambda n: F.when(n.isNotNull(), F.struct(n["pre"].alias("pre"), n["last"].alias("last")))
        meta = lambda key, value: T.strip(first(lambda n: (n["tag"] == "meta") & (n[key] == value))["content"])
        body = F.coalesce(span(first(lambda n: n["tag"].isin("article", "main", "section"))), span(first(lambda n: n["tag"] == "body")), whole)

        def of_part(part: Column) -> Column:
            own = inside(nodes, part)
            texts = lambda test: F.transform(F.filter(own, test), lambda n: text_of(tags, n, True))
            heads = _longer(texts(lambda n: n["tag"].isin("h1", "h2", "h3")), 10, 200)
            blocks = _longer(texts(lambda n: n["tag"].isin("p", "li", "span", "div") & (n["shown_children"] <= 5)), 20, 800)
            return F.concat(F.filter(F.array(meta("name", "description"), meta("property", "og:description")), lambda m: m.isNotNull() & (m != "")), heads, blocks)

        return let(body, of_part)

    texts = let(F.filter(tags["nodes"], lambda n: ~n["hidden"]), of)
    joined = F.regexp_replace(F.array_join(texts, " "), r"(?U)\s+", " ")
    whole = T.collapse(F.regexp_replace(joined, r"(?U)[^\w\s.,;:!?()'\"/-]", " "))
    return whole if most is None else F.substring(whole, 1, most)


def section_text(tags: Column, words: tuple[str, ...], most: int = 5) -> Column:
    """Texts of elements whose class or id holds a word, word by word, class before id."""
    found = lambda word, a: F.transform(F.filter(tags["nodes"], lambda n: n[a].contains(word)), lambda n: text_of(tags, n))
    return F.array_join(F.slice(_longer(F.concat(*(found(w, a) for w in words for a in ("class", "id"))), 15, 1000), 1, most), " ")


def listed_text(tags: Column, most: int = 10, rows: int = 10) -> Column:
    """Rows of tables, their cells between bars, and items of lists; up to ``rows`` of each table or list."""
    nodes = tags["nodes"]
    outer = lambda *names: F.filter(nodes, lambda n: n["tag"].isin(*names))
    inner = lambda n, *names: F.filter(inside(nodes, n), lambda x: x["tag"].isin(*names))
    cells = lambda row: F.array_join(F.transform(inner(row, "td", "th"), lambda c: text_of(tags, c)), " | ")
    lines = F.flatten(F.transform(outer("table"), lambda t: F.transform(F.slice(inner(t, "tr"), 1, rows), cells)))
    items = F.flatten(F.transform(outer("ul", "ol"), lambda u: F.transform(F.slice(inner(u, "li"), 1, rows), lambda li: text_of(tags, li))))
    return F.array_join(F.slice(_longer(F.concat(lines, items), 15, 500), 1, most), " ")


def heading_text(tags: Column, most: int = 10) -> Column:
    """The meta description and up to ten distinct headings."""
    meta = F.get(F.filter(tags["nodes"], lambda n: (n["tag"] == "meta") & (n["name"] == "description")), F.lit(0))["content"]
    heads = _longer(F.transform(F.filter(tags["nodes"], lambda n: n["tag"].isin("h1", "h2", "h3")), lambda n: text_of(tags, n)), 15, 120)
    good = F.array_distinct(F.filter(heads, lambda t: ~F.exists(F.array(*(F.lit(b) for b in L.HEADING_BLACKLIST)), lambda b: F.lower(t).contains(b))))
    return T.strip(F.concat_ws(" ", T.strip(F.coalesce(meta, F.lit(""))), F.array_join(F.slice(good, 1, most), " ")))
