"""Fit scores. Arithmetic is decimal and rounds half up; results are doubles.

A decimal contract keeps scores equal in any engine. Against binary floating point with
half-even rounding it can differ by 0.01 at exact ties.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.arrays import contains_any, count_present, let, strings, word_list
from .lexicon import best_weight, factor

LEXICON = {
    "domain_strong": L.DOMAIN_STRONG, "domain_medium": L.DOMAIN_MEDIUM, "product_strong": L.PRODUCT_STRONG,
    "product_medium": L.PRODUCT_MEDIUM, "ai_strong": L.AI_STRONG, "ai_medium": L.AI_MEDIUM, "use_cases": L.USE_CASE_WEIGHTS,
}
SHARES = {"domain": "0.35", "product": "0.25", "ai": "0.20", "use_case": "0.20"}


def decimal(value: Column | str, kind: str = "decimal(12,4)") -> Column:
    return (F.lit(value) if isinstance(value, str) else value).cast(kind)


def _joined(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *(F.coalesce(p, F.lit("")) for p in parts)))


def _list(items: Column | None) -> Column:
    return F.lit("") if items is None else F.array_join(F.coalesce(items, strings(())), " ")


def factors(
    text: Column,
    industry: Column | None = None,
    products: Column | None = None,
    services: Column | None = None,
    technologies: Column | None = None,
    use_cases: Column | None = None,
    lexicon: Mapping = LEXICON,
) -> dict[str, Column]:
    """Points of each factor, 0 to 100. Each reads the text and its own attributes."""
    domain = _joined(text, F.lit("") if industry is None else industry, _list(use_cases))
    product = _joined(text, _list(products), _list(services))
    ai = _joined(text, _list(technologies))
    use = _joined(text, _list(use_cases))
    named = F.lit(0) if products is None else F.least(F.size(F.filter(F.coalesce(products, strings(())), lambda p: F.length(p) > 3)) * 8, F.lit(24))
    return {
        "domain": factor(domain, lexicon["domain_strong"], lexicon["domain_medium"], 28, 10),
        "product": factor(product, lexicon["product_strong"], lexicon["product_medium"], 25, 10, named),
        "ai": factor(ai, lexicon["ai_strong"], lexicon["ai_medium"], 22, 8),
        "use_case": best_weight(use, lexicon["use_cases"]),
    }


def need(text: Column, signals: Sequence[str] = L.NEED_SIGNALS) -> Column:
    return F.least(count_present(F.lower(text), signals) * 9, F.lit(100)).cast("double")


def breakdown(points: Mapping[str, Column]) -> dict[str, Column]:
    """Weighted shares, as decimals of two places."""
    return {k: F.round(decimal(points[k]) * decimal(share, "decimal(4,2)"), 2).cast("decimal(8,2)") for k, share in SHARES.items()}


def total(parts: Mapping[str, Column]) -> Column:
    out = decimal("0", "decimal(10,2)")
    for p in parts.values():
        out = out + p
    return F.least(out, decimal("100", "decimal(10,2)")).cast("decimal(10,2)")


def adjusted(base: Column, multiplier: Column, penalty: Column) -> Column:
    value = F.round(base.cast("decimal(10,2)") * multiplier.cast("decimal(4,2)") - penalty.cast("decimal(6,2)"), 2).cast("decimal(10,2)")
    return F.greatest(F.least(value, decimal("100", "decimal(10,2)")), decimal("0", "decimal(10,2)"))


def multiplier(quality: Column, extracted: Column) -> Column:
    by_quality = F.when(quality == "GOOD", decimal("1.00")).when(quality == "LOW", decimal("0.70")).otherwise(decimal("0.50"))
    return F.round(by_quality * F.when(extracted, decimal("1.00")).otherwise(decimal("0.60")), 2).cast("decimal(4,2)")


def penalty(quality: Column, extracted: Column, confidence: Column) -> Column:
    return F.when(~extracted, 10).when(quality == "LOW", 5).when(confidence < 0.45, 5).otherwise(0)


def category(score: Column, levels: Sequence[tuple[int | None, str]] = L.CATEGORIES) -> Column:
    out = None
    for least, name in levels:
        if least is None:
            return F.lit(name) if out is None else out.otherwise(name)
        out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
    return out


def recommendation(text: Column, products: Column | None = None, profiles=L.RECOMMENDATIONS) -> Column:
    probe = _joined(text, _list(products))
    out = None
    for words, items in profiles:
        if not words:
            return strings(items) if out is None else out.otherwise(strings(items))
        out = F.when(contains_any(probe, words), strings(items)) if out is None else out.when(contains_any(probe, words), strings(items))
    return out


def number_text(value: Column) -> Column:
    """A number as its shortest text with at least one decimal: 60.4, 35.0."""
    fixed = F.format_string("%.2f", value.cast("double"))
    return F.regexp_replace(fixed, r"(\.[0-9])0\z", "$1")


def reason(parts: Mapping[str, Column], industry: Column, use_cases: Column, score: Column, target: str = L.TARGET) -> Column:
    domain, ai, use = (parts[k].cast("double") for k in ("domain", "ai", "use_case"))
    first = F.coalesce(F.get(use_cases, F.lit(0)), F.lit("aligned application"))
    sector = F.coalesce(F.nullif(industry, F.lit("")), F.lit("target sector"))
    signals = F.array_compact(F.array(
        F.when(domain >= 12, F.concat(F.lit("domain match ("), sector, F.lit(")"))),
        F.when(ai >= 8, F.lit("AI/vision capabilities")),
        F.when(use >= 8, F.concat(F.lit("use case: "), first)),
        F.when(use >= 10, F.lit("strong use-case alignment")),
    ))
    return F.when(F.size(signals) == 0, L.WEAK_REASON.format(target=target)).otherwise(F.concat(F.lit(L.FIT_REASON.format(target=target)), F.array_join(signals, "; "), F.lit(" (score "), number_text(score), F.lit(").")))


def score_text(text: Column, lexicon: Mapping = LEXICON) -> Column:
    """Score of a bare text, without attributes."""
    return total(breakdown(factors(text, lexicon=lexicon))).cast("double")


def _ratio(n: Column, of: int, weight: str) -> Column:
    return F.least(n.cast("decimal(10,6)") / of, decimal("1", "decimal(10,6)")) * decimal(weight, "decimal(4,2)")


def specific_count(technologies: Column, specific: Sequence[str] = L.SPECIFIC_TECHNOLOGIES) -> Column:
    """How many specific terms some technology holds."""
    held = lambda low: F.filter(word_list(specific), lambda term: F.exists(low, lambda t: t.contains(term)))
    return F.size(let(F.transform(technologies, F.lower), held))


def extraction_confidence(named: Column, products: Column, technologies: Column, industry: Column, use_cases: Column, text: Column) -> Column:
    """Completeness of an extracted profile, 0 to 1; ``named`` counts products that look like names."""
    n = F.length(text)
    bonus = F.when(n >= 2000, decimal("0.10")).when(n >= 1000, decimal("0.06")).when(n >= 500, decimal("0.03")).otherwise(decimal("0"))
    raw = (
        _ratio(named, 3, "0.28") + _ratio(F.size(products), 5, "0.07") + _ratio(specific_count(technologies), 4, "0.22")
        + _ratio(F.size(technologies), 6, "0.10") + F.when(industry != "", decimal("0.12")).otherwise(decimal("0")) + _ratio(F.size(use_cases), 3, "0.11") + bonus
    )
    return F.round(F.least(raw, decimal("1")), 2).cast("double")


def fallback_confidence(technologies: Column, industry: Column, use_cases: Column) -> Column:
    """Confidence of a keyword profile: between 0.30 and 0.40."""
    raw = (
        _ratio(specific_count(technologies), 4, "0.18") + _ratio(F.size(technologies), 5, "0.10")
        + F.when(industry != "", decimal("0.07")).otherwise(decimal("0")) + _ratio(F.size(use_cases), 3, "0.08")
    )
    return F.round(F.least(F.greatest(raw, decimal("0.30")), decimal("0.40")), 2).cast("double")
