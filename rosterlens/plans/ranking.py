"""From a roster and page texts to a ranked, explained list: one lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..functions.arrays import strings
from ..operators import profile as P
from ..operators import score as S
from ..operators.roster import keep_last, left_with_defaults

LEAST_CHARS = 800
#: Attributes that a company without a profile gets.
DEFAULTS = {
    "summary": "", "text": "", "industry": "", "products": strings, "services": strings, "technologies": strings, "use_cases": strings,
    "confidence": 0.0, "multiplier": 1.0, "penalty": 0,
}


def ranked(companies: DataFrame, lexicon: Mapping = S.LEXICON, target: str = L.TARGET) -> DataFrame:
    """Scores, explanations and order of companies whose attributes are columns.

    Reads text, summary, industry, products, services, technologies, use_cases, confidence,
    multiplier, penalty and ord. Adds score, breakdown, category, recommended_products, reason.
    """
    body = F.concat_ws(" ", F.coalesce("summary", F.lit("")), F.coalesce("text", F.lit("")))
    df = companies.withColumn("__text", body)
    points = S.factors(F.col("__text"), F.col("industry"), F.col("products"), F.col("services"), F.col("technologies"), F.col("use_cases"), lexicon)
    df = df.withColumns({f"__{k}": v for k, v in S.breakdown(points).items()})
    parts = {k: F.col(f"__{k}") for k in points}
    df = df.withColumn("__score", S.adjusted(S.total(parts), F.col("multiplier"), F.col("penalty")))
    df = df.withColumns({
        "score": F.col("__score").cast("double"), "breakdown": F.struct(*(c.cast("double").alias(k) for k, c in parts.items())),
        "category": S.category(F.col("__score")), "recommended_products": S.recommendation(F.col("__text"), F.col("products")),
        "reason": S.reason(parts, F.col("industry"), F.col("use_cases"), F.col("__score"), target),
    })
    return df.drop("__text", "__score", *(f"__{k}" for k in points))


def in_order(df: DataFrame) -> DataFrame:
    """By score, ties in input order."""
    return df.orderBy(F.desc("score"), "ord")


def _latest(rows: DataFrame, order: str | None) -> DataFrame:
    """One row of each website: the last by ``order``, ties and no order by the values themselves."""
    rows = rows.withColumn("__at", F.col(order) if order else F.lit(0))
    return keep_last(rows, ["website"], "__at").drop("__at", *([order] if order else []))


def outcomes(
    roster: DataFrame,
    pages: DataFrame,
    extractor: Callable[[DataFrame], DataFrame] | None = None,
    lexicon: Mapping = S.LEXICON,
    offline: bool = False,
    target: str = L.TARGET,
    order: str | None = None,
) -> DataFrame:
    """Every company of a roster: ranked attributes, or ``skip_reason``.

    ``roster``: ord, name, website. ``pages``: website, all, products, services,
    specifications, quality; of a website's rows the last by ``order`` counts (without an
    order, the one of largest values). ``extractor`` adds ``reply``
    (a model's raw answer) to rows with ``text``; without one every profile comes from
    keywords. ``offline`` counts those as extracted, so that only weak confidence is penalised.
    """
    pages = _latest(pages, order)
    pages = pages.withColumnsRenamed({"products": "page_products", "services": "page_services"})
    joined = roster.join(pages, "website", "left")
    text = T.collapse(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in ("all", "page_products", "page_services", "specifications"))))
    joined = joined.withColumn("text", text).withColumn("quality", F.coalesce("quality", F.lit("FAILED")))
    gate = F.when(F.col("all").isNull(), "crawl_error").when(F.length("all") < LEAST_CHARS, "too_short")
    joined = joined.withColumn("skip_reason", gate)
    if extractor is None:
        # Skipped rows go along with an empty text, so that the join is made once.
        whole = joined.withColumn("text", F.when(F.col("skip_reason").isNull(), F.col("text")))
        df = P.fallback_profile(whole).withColumn("extracted", F.lit(offline))
    else:
        asked = extractor(joined.filter("skip_reason is null").withColumn("text_for_model", P.relevant_text(F.col("text"), 900)))
        df = P.checked_profile(asked).drop("text_for_model", "reply").withColumnRenamed("ok", "extracted")
    nothing = F.col("skip_reason").isNull() & P.hopeless(F.col("confidence"), F.col("technologies"), F.col("industry"))
    df = df.withColumn("skip_reason", F.when(nothing, "no_signal").otherwise(F.col("skip_reason")))
    df = df.withColumns({
        "summary": T.summary_or_opening(F.col("text")), "contact_email": T.email(F.col("text")), "phone": T.phone(F.col("text")), "price_range": T.prices(F.col("text")),
        "product_specifications": T.blank_to_null(F.col("specifications")), "multiplier": S.multiplier(F.col("quality"), F.col("extracted")),
        "penalty": S.penalty(F.col("quality"), F.col("extracted"), F.col("confidence")),
    })
    df = ranked(df, lexicon, target).drop("all", "page_products", "page_services", "specifications")
    own = ("ord", "name", "website", "quality", "skip_reason")
    if extractor is None:
        gated = F.col("skip_reason").isin("crawl_error", "too_short")
        return df.select(*own, *(F.when(~gated | gated.isNull(), F.col(c)).alias(c) for c in df.columns if c not in own))
    return df.unionByName(joined.filter("skip_reason is not null").select(*own), allowMissingColumns=True)


def rank_companies(roster: DataFrame, pages: DataFrame, **options) -> DataFrame:
    """The qualified companies of ``outcomes``, best first."""
    return in_order(outcomes(roster, pages, **options).filter("skip_reason is null")).withColumnRenamed("name", "company_name")


def rank_profiles(roster: DataFrame, profiles: DataFrame, lexicon: Mapping = S.LEXICON, order: str | None = None) -> DataFrame:
    """Rank a roster by profiles keyed by website; a company without one gets defaults.

    Of a website's profiles the last by ``order`` counts; without an order, the one of largest values.
    """
    profiles = _latest(profiles, order)
    have = set(profiles.columns)
    value = lambda v: strings(()) if v is strings else F.lit(v)
    profiles = profiles.withColumns({c: value(v) for c, v in DEFAULTS.items() if c not in have})
    df = left_with_defaults(roster, profiles.select("website", *DEFAULTS), ["website"], {c: value(v) for c, v in DEFAULTS.items()})
    return in_order(ranked(df, lexicon))
