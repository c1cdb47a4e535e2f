"""Company data from sites: crawl, visible text, relevant sections, one profile a page, merged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..functions import urls as U
from ..functions.arrays import distinct_ignoring_case, strings
from ..operators import crawl as C
from ..operators import html as H
from ..operators import profile as P
from ..operators import roster as O


def page_sections(visited: DataFrame) -> DataFrame:
    """``visited`` with ``text``: the sentences of its visible text that hold a word about products, distinct without case."""
    found = distinct_ignoring_case(T.sentences_with(H.visible_text(F.col("html")), L.SECTION_WORDS))
    return visited.withColumn("text", F.array_join(found, "\n"))


def keyword_pages(pages: DataFrame) -> DataFrame:
    """``pages`` with products, technologies and industry of their text from keywords."""
    t, low, held = F.col("text"), F.col("__low"), F.col("__held")
    found = {"products": P.rescue_products(t, low=low), "technologies": F.slice(P.infer_technologies(t, low=low, held=held), 1, 8), "industry": P.infer_industry(t, low=low, held=held)}
    return pages.withColumn("__low", F.lower(F.coalesce(t, F.lit("")))).withColumn("__held", P.words_held(low)).withColumns(found).drop("__low", "__held")


def replied_pages(extractor: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Pages read by a model: ``extractor`` adds ``reply``; an unreadable one, or none, holds nothing."""

    def read(pages: DataFrame) -> DataFrame:
        asked = extractor(pages).withColumn("__r", P.parse_reply(F.col("reply")))
        of = lambda c: F.coalesce(F.col(f"__r.{c}"), strings(()))
        return asked.withColumns({"products": of("products"), "technologies": of("technologies"), "industry": F.coalesce(F.col("__r.industry"), F.lit(""))})

    return read


def company_data(roster: DataFrame, pages: DataFrame, read: Callable[[DataFrame], DataFrame] = keyword_pages, website: str = "website", **crawl_options) -> DataFrame:
    """(website, company_url, products, technologies, industry, confidence): what the pages of each site hold.

    Lists are merged in the order of the visit, distinct without case; the industry is the first page's that has one; the confidence is the share
    of pages that hold anything. A site without a page has empty lists and confidence 0.
    """
    visited = page_sections(C.crawl_depth(roster, pages, website=website, **crawl_options))
    data = read(visited).select(website, "at", "products", "technologies", F.coalesce("industry", F.lit("")).alias("industry"))
    held = (F.size("products") > 0) | (F.size("technologies") > 0) | (F.col("industry") != "")
    merged = O.merged_lists(data, website, "at", ["products", "technologies"], ["industry"])
    out = roster.select(website).distinct().join(merged, website, "left").join(O.coverage(data, website, held), website, "left")
    return out.select(
        website, U.normalize(F.col(website)).alias("company_url"), F.coalesce("products", strings(())).alias("products"), F.coalesce("technologies", strings(())).alias("technologies"),
        F.coalesce("industry", F.lit("")).alias("industry"), F.coalesce("coverage", F.lit(0.0)).alias("confidence"),
    )
