"""Text, sections and links of raw pages.

What patterns can express is native; what needs a page's elements works on the intervals of ``tags``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..functions import urls as U
from ..functions.arrays import distinct_ignoring_case, let

HIDDEN = ("script", "style", "noscript", "nav", "footer", "header", "svg")
#: Entities that native text extraction resolves, the ampersand last. Fixed values.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
HREF = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""


def visible_text(html: Column, hidden: tuple[str, ...] = HIDDEN) -> Column:
    """Text outside of hidden elements, single spaces."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", " ")
    for tag in hidden:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return T.collapse(out)


def links(html: Column) -> Column:
    """Array of (href, anchor text), in document order."""
    html = F.coalesce(html, F.lit(""))
    href, inner = (F.regexp_extract_all(html, F.lit(HREF), F.lit(i)) for i in (1, 2))
    return F.transform(F.arrays_zip(href.alias("href"), inner.alias("inner")), lambda x: F.struct(T.strip(x["href"]).alias("href"), T.collapse(F.regexp_replace(x["inner"], r"(?s)<[^>]*>", "")).alias("anchor")))


def plain_links(html: Column, base: Column) -> Column:
    """Addresses that a page names, resolved and normalised, distinct without case."""
    return distinct_ignoring_case(F.transform(F.filter(links(html), lambda x: x["href"] != ""), lambda x: U.normalize(U.resolve(base, x["href"]))))


def scored_links(html: Column, base: Column, most: int = 6, avoid: tuple[str, ...] = L.AVOID, hints=L.PATH_HINTS, keywords=L.LINK_WORDS) -> Column:
    """Array of (url, score) of a page's best links within its own site, best first."""
    good = F.filter(links(html), lambda x: (x["href"] != "") & ~x["href"].rlike("^(?:#|mailto:|tel:|javascript:)"))
    full = F.transform(good, lambda x: F.struct(U.normalize(U.resolve(base, x["href"])).alias("url"), x["anchor"].alias("anchor")))
    own = let(U.domain(base), lambda site: F.filter(full, lambda x: (x["url"] != "") & (U.domain(x["url"]) == site) & ~U.should_skip(x["url"], avoid)))
    scored = F.filter(F.transform(own, lambda x: F.struct(x["url"].alias("url"), U.link_score(x["url"], x["anchor"], hints, keywords).alias("score"))), lambda x: x["score"] > 0)

    def best(both: Column) -> Column:
        ranked = F.transform(
            F.array_distinct(both["u"]),
            lambda u: F.struct((-F.array_max(F.transform(F.filter(both["s"], lambda x: x["url"] == u), lambda x: x["score"]))).alias("minus"), F.array_position(both["u"], u).alias("at"), u.alias("url")),
        )
        return F.transform(F.slice(F.array_sort(ranked), 1, most), lambda x: F.struct(x["url"].alias("url"), (-x["minus"]).alias("score")))

    return let(scored, lambda s: let(F.struct(s.alias("s"), F.transform(s, lambda x: x["url"]).alias("u")), best))


PARTS = ("main", "products", "services", "specifications", "headings")


def page_parts(pages: DataFrame, html_col: str = "html", cut_entities: bool = True) -> DataFrame:
    """``pages`` with a struct ``parts`` of texts that need the page's elements. A null page has empty parts."""
    from . import tags as G

    t = F.col("__tags")
    parts = {
        "main": G.main_text(t), "products": G.section_text(t, ("product", "solution")), "services": G.section_text(t, ("service", "offering")),
        "specifications": G.listed_text(t), "headings": G.heading_text(t),
    }
    # The scan is a step of its own, so that the five texts share it.
    return G.with_tags(pages, html_col, "__tags", cut_entities).withColumn("parts", F.struct(*(parts[p].alias(p) for p in PARTS))).drop("__tags")


def urls_joined(base: Column, href: Column) -> Column:
    """``resolve`` by the standard library, for forms that the native one doesn't cover."""
    import pandas as pd

    def join(bases: pd.Series, hrefs: pd.Series) -> pd.Series:
        from urllib.parse import urljoin

        return pd.Series([urljoin(b or "", h or "") for b, h in zip(bases, hrefs, strict=True)])

    return F.pandas_udf(join, "string", F.PandasUDFType.SCALAR)(base, href)
