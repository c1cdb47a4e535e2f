"""Structured profiles of companies: from keywords alone, or validated from a model's reply.

The native path is the default. A model is an optional extractor whose raw replies arrive as
a column; parsing and validation of them stay in Column expressions.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import variants
from ..functions.arrays import STRINGS, append_missing, contains_any, count_present, let, strings, without
from ..functions.text import SENTENCE, clean_string, sentences, strip, strip_chars, words
from .lexicon import best_label, held_words, top_labels
from .score import extraction_confidence, fallback_confidence

#: Bounds of words in ASCII, spelled out: what ``\b`` makes of other letters changed between versions of Java.
_B, _E = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
#: Patterns of product sentences, brands and names. Results hang on them.
CONTEXT_WORDS = ("product", "platform", "software", "system", "solution", "tool", "suite", "robot", "drone", "vehicle", "device", "sensor", "engine", "sdk", "api")
CONTEXT = rf"(?i){_B}(?:{'|'.join(CONTEXT_WORDS)}){_E}"
BRAND = rf"{_B}[A-Z][a-z]+(?:[A-Z][a-z]*)+{_E}|{_B}[A-Z]{{2,5}}(?:[0-9]+)?{_E}|{_B}[A-Z][a-z]+ [A-Z][a-z]+"
NAME_LIKE = rf"{_B}[A-Z][a-z]+(?:[A-Z][a-z]*)+{_E}|{_B}[A-Z]{{2,}}[0-9]+{_E}|{_B}[A-Z][a-z]+ [A-Z][a-z]+{_E}"
PUNCTUATION = ".,;:!?"


def _bare(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), r"[.,;:!?]+\z", "")


def _any_word(items: Column, allowed: Sequence[str]) -> Column:
    return F.exists(items, lambda w: _bare(w).isin(*allowed))


def brand_token(token: Column) -> Column:
    """Looks like a name: inner capitals, an acronym, a digit after a capital, or a brand's ending."""
    t = strip_chars(token, PUNCTUATION)
    ending = "|".join(L.BRAND_SUFFIXES)
    return (
        t.rlike(r"^[A-Z][a-z]+(?:[A-Z][a-z]*)+\z") | t.rlike(r"^[A-Z]{2,6}[0-9]{0,3}\z") | (t.rlike("^[A-Z]") & t.rlike("[0-9]"))
        | (t.rlike("^[A-Z]") & F.lower(t).rlike(rf"(?:{ending})\z") & (F.length(t) > 4))
    )


def _lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def infer_technologies(text: Column, existing: Column | None = None, rules: Sequence[tuple[str, str]] = L.TECHNOLOGIES, low: Column | None = None, held: Column | None = None) -> Column:
    """Existing names, then canonical names of keywords present, unless one holds another.

    ``low``: the text in lower case, and ``held``: ``words_held`` of it, if they are at hand.
    """
    low = F.concat(F.lit(" "), _lowered(text) if low is None else low, F.lit(" "))
    existing = strings(()) if existing is None else existing
    table = F.from_json(F.lit(json.dumps([{"word": k, "name": c, "low": c.lower()} for k, c in rules])), "array<struct<word: string, name: string, low: string>>")

    def fold(acc: Column, r: Column) -> Column:
        near = lambda names: F.exists(names, lambda n: F.lower(n).contains(r["low"]) | r["low"].contains(F.lower(n)))
        return F.when(~near(existing) & ~near(acc), F.concat(acc, F.array(r["name"]))).otherwise(acc)

    held = held_words(low, [k for k, _ in rules]) if held is None else held
    return F.array_distinct(F.concat(existing, let(held, lambda names: F.aggregate(F.filter(table, lambda r: F.array_contains(names, r["word"])), strings(()), lambda acc, r: fold(acc, r)))))


def words_held(low: Column) -> Column:
    """The words of the default lists of technologies, industries and use cases that a lowered text holds, a space before and behind it."""
    return held_words(F.concat(F.lit(" "), low, F.lit(" ")), [r[0] for r in (*L.TECHNOLOGIES, *L.INDUSTRY_SIGNALS, *L.USE_CASE_SIGNALS)])


def infer_industry(text: Column, rules=L.INDUSTRY_SIGNALS, low: Column | None = None, held: Column | None = None) -> Column:
    return best_label(_lowered(text) if low is None else low, rules, held=held)


def infer_use_cases(text: Column, rules=L.USE_CASE_SIGNALS, most: int = 4, low: Column | None = None, held: Column | None = None) -> Column:
    return top_labels(_lowered(text) if low is None else low, rules, most, lone_words_twice=True, held=held)


def validate_industry(label: Column, technologies: Column, text: Column, overrides=L.INDUSTRY_OVERRIDES) -> Column:
    """The first override whose words occur often enough; else the label, if the text bears it out."""
    low = F.lower(text)
    probe = F.concat(F.array_join(F.transform(technologies, F.lower), " "), F.lit(" "), F.substring(low, 1, 800))
    parts = words(label)
    key = F.transform(F.filter(parts, lambda w: F.length(w) > 4), F.lower)
    doubtful = (label != "") & ((F.size(parts) > 4) | ((F.size(key) > 0) & ~F.exists(key, lambda w: low.contains(w))))
    inferred = infer_industry(text)
    out = None
    for signals, name, least in overrides:
        hit = count_present(probe, signals) >= least
        out = F.when(hit, name) if out is None else out.when(hit, name)
    rest = F.when(doubtful & (inferred != ""), inferred).when(label != "", label).otherwise(inferred)
    return rest if out is None else out.otherwise(rest)


def rescue_products(text: Column, most: int = 3, low: Column | None = None) -> Column:
    """Brand-like tokens from sentences about products, up to the sentence that brings three."""
    banned = sorted(set(L.RESCUE_SKIP) | set(L.GENERIC_TERMS))

    def fold(acc: Column, s: Column) -> Column:
        found = F.transform(F.regexp_extract_all(s, F.lit(BRAND), F.lit(0)), strip)
        found = F.filter(found, lambda t: ~F.lower(t).isin(*banned) & F.length(t).between(3, 40))
        return F.when((F.size(acc) >= 3) | ~s.rlike(CONTEXT), acc).otherwise(F.array_distinct(F.concat(acc, found)))

    # A text without such a word has no such sentence, and isn't cut up.
    folded = F.aggregate(F.split(F.coalesce(text, F.lit("")), r"[.!?\n]+"), strings(()), fold)
    candidates = F.when(contains_any(_lowered(text) if low is None else low, CONTEXT_WORDS), folded).otherwise(strings(()))
    return F.slice(without(candidates, [c for _, c in L.TECHNOLOGIES]), 1, most)


def rescue_from_services(services: Column) -> tuple[Column, Column]:
    """Services that are named like products, and the rest."""

    def named(s: Column) -> Column:
        w = words(s)
        return (F.size(w) > 0) & F.get(w, F.lit(0)).rlike(r"^\p{Lu}") & F.lower(F.element_at(w, -1)).isin(*L.PRODUCT_INDICATORS)

    return F.filter(services, named), F.filter(services, lambda s: ~F.coalesce(named(s), F.lit(False)))


def _items(raw: Column) -> Column:
    stripped = F.transform(F.coalesce(raw, strings(())), lambda x: strip_chars(strip(x), "\"'"))
    return F.filter(stripped, lambda x: x.isNotNull() & (x != ""))


def clean_products(raw: Column, text: Column, most: int = 5) -> Column:
    return let(F.lower(text), lambda low: _clean_products(raw, low, most))


def _clean_products(raw: Column, low: Column, most: int) -> Column:
    generic = sorted(set(L.GENERIC_NOUNS) | set(L.GENERIC_TERMS))
    plain = sorted(set(generic) | set(L.SENTENCE_STARTERS) | set(L.VERBS))

    def fit(item: Column) -> Column:
        w = words(item)
        first, rest = _bare(F.get(w, F.lit(0))), F.slice(w, 2, 1 << 20)
        tokens = F.filter(w, lambda x: (F.length(x) > 4) & ~F.lower(x).isin(*L.GENERIC_IN_PRODUCTS))
        grounded = F.when(F.size(tokens) == 0, low.contains(F.lower(item))).otherwise(F.exists(tokens, lambda x: low.contains(F.lower(x))))
        unnamed = ~F.exists(w, brand_token) & (
            ((F.size(w) == 2) & F.forall(w, lambda x: _bare(x).isin(*generic))) | F.forall(w, lambda x: _bare(x).isin(*plain))
        )
        bad = (
            ~F.size(w).between(1, 5) | first.isin(*L.SENTENCE_STARTERS, *L.PRODUCT_VERB_PREFIXES) | (first.endswith("ing") & (F.length(first) > 5))
            | (first.endswith("ed") & (F.length(first) > 4) & ~first.isin("named", "called")) | _any_word(rest, L.SENTENCE_STARTERS)
            | F.lower(item).isin(*L.GENERIC_TERMS) | ~F.exists(w, lambda x: x.rlike(r"^\p{Lu}")) | _any_word(w, L.VERBS)
            | item.rlike(r"(?U)[.!?]\s") | unnamed
        )
        return ~bad & grounded

    return F.slice(F.array_distinct(F.filter(_items(raw), fit)), 1, most)


def clean_technologies(raw: Column) -> Column:
    known = sorted({c.lower() for _, c in L.TECHNOLOGIES} | set(L.SPECIFIC_TECHNOLOGIES))

    def fit(item: Column) -> Column:
        w, low = words(item), F.lower(item)
        first = _bare(F.get(w, F.lit(0)))
        technical = F.exists(w, lambda x: x.rlike(r"^[A-Z]{2,}[0-9]*\z|^[A-Z][a-z]+[A-Z]")) | contains_any(low, L.TECH_PARTS)
        bad = (F.size(w) > 4) | low.isin(*L.GENERIC_TERMS) | first.isin(*L.SENTENCE_STARTERS, *L.TECH_BAD_STARTERS) | _any_word(w, L.VERBS) | ((F.size(w) > 1) & ~technical)
        return low.isin(*known) | ~bad

    return F.array_distinct(F.filter(_items(raw), fit))


def clean_services(raw: Column, text: Column) -> Column:
    low = F.lower(text)

    def fit(item: Column) -> Column:
        w = words(item)
        long = F.transform(F.filter(w, lambda x: F.length(x) > 3), lambda x: strip_chars(F.lower(x), PUNCTUATION))
        present = F.size(F.filter(long, lambda x: low.contains(x)))
        grounded = (F.size(long) == 0) | (present >= F.greatest(F.lit(1), F.floor(F.size(long) / 2)))
        bad = (F.size(w) > 5) | F.lower(item).isin(*L.GENERIC_TERMS, *L.FAKE_SERVICES) | F.lower(F.get(w, F.lit(0))).isin(*L.SENTENCE_STARTERS) | _any_word(w, L.VERBS)
        return ~bad & grounded

    return F.array_distinct(F.filter(_items(raw), fit))


def clean_use_cases(raw: Column) -> Column:
    def fit(item: Column) -> Column:
        w = words(item)
        return F.size(w).between(2, 6) & ~contains_any(item, L.VAGUE_USE_CASES) & ~_any_word(w, L.VERBS)

    return F.array_distinct(F.filter(F.transform(_items(raw), F.lower), fit))


def relevant_text(text: Column, most: int) -> Column:
    """Sentences within a budget of characters: with names first, then with relevant words, then the rest."""
    return let(sentences(F.coalesce(text, F.lit("")), SENTENCE), lambda parts: _within_budget(parts, text, most))


def _within_budget(parts: Column, text: Column, most: int) -> Column:
    named = lambda s: s.rlike(NAME_LIKE)
    domain = lambda s: ~named(s) & contains_any(F.lower(s), L.RELEVANT_WORDS)
    order = F.concat(F.filter(parts, named), F.filter(parts, domain), F.filter(parts, lambda s: ~named(s) & ~domain(s)))
    zero = F.struct(strings(()).alias("kept"), F.lit(most).alias("left"))
    kept = F.aggregate(
        order, zero,
        lambda acc, s: F.when(acc["left"] <= 0, acc).otherwise(F.struct(F.concat(acc["kept"], F.array(F.substring(s, F.lit(1), acc["left"]))).alias("kept"), (acc["left"] - F.length(s) - 1).alias("left"))),
    )["kept"]
    joined = strip(F.array_join(kept, " "))
    return F.substring(F.when(F.length(joined) < 150, F.substring(text, 1, most)).otherwise(joined), 1, most)


FIELDS = ("products", "services", "technologies", "industry", "use_cases", "confidence")


def fallback_profile(df: DataFrame, text_col: str = "text", most_technologies: int = 8) -> DataFrame:
    """``df`` with products, services, technologies, industry, use_cases and confidence from keywords."""
    text, low, held = F.coalesce(F.col(text_col), F.lit("")), F.col("__low"), F.col("__held")
    df = df.withColumn("__low", F.lower(text)).withColumn("__held", words_held(low)).withColumns({
        "technologies": infer_technologies(text, low=low, held=held), "products": rescue_products(text, low=low), "services": strings(()), "industry": infer_industry(text, low=low, held=held),
        "use_cases": infer_use_cases(text, low=low, held=held),
    }).drop("__low", "__held")
    df = df.withColumn("confidence", fallback_confidence(F.col("technologies"), F.col("industry"), F.col("use_cases")))
    return df.withColumn("technologies", F.slice("technologies", 1, most_technologies))


def checked_profile(df: DataFrame, reply_col: str = "reply", text_col: str = "text") -> DataFrame:
    """``df`` with the profile of a model's reply where that could be read, else from keywords; ``ok`` says which.

    Both are columns of one pass, so that a reply is asked for once.
    """
    read = validated_profile(df, reply_col, text_col).withColumnsRenamed({c: f"__{c}" for c in FIELDS})
    bare = read.withColumn("__bare", F.when(~F.col("ok"), F.col(text_col)))
    both = fallback_profile(bare, "__bare")
    return both.withColumns({c: F.when(F.col("ok"), F.col(f"__{c}")).otherwise(F.col(c)) for c in FIELDS}).drop("__bare", *(f"__{c}" for c in FIELDS))


def parse_reply(raw: Column) -> Column:
    """The reply's fields; null where it isn't valid JSON. An industry may be text or a list; lists that are none are empty."""

    def fields(v: Column) -> Column:
        lists = [F.coalesce(F.try_variant_get(v, f"$.{c}", STRINGS), strings(())).alias(c) for c in ("products", "services", "technologies", "use_cases")]
        listed = F.try_variant_get(v, "$.industry", "array<variant>")
        industry = F.coalesce(F.when(listed.isNotNull(), F.try_variant_get(v, "$.industry[0]", "string")).otherwise(F.try_variant_get(v, "$.industry", "string")), F.lit(""))
        return F.when(v.isNotNull(), F.struct(*lists, industry.alias("industry")))

    return let(variants.parse(raw), fields)


def validated_profile(df: DataFrame, reply_col: str = "reply", text_col: str = "text") -> DataFrame:
    """``df`` with a profile checked against its text, and ``ok``: whether the reply could be read."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = df.withColumn("__r", parse_reply(F.col(reply_col))).withColumn("ok", F.col("__r").isNotNull())
    rescued, services = rescue_from_services(F.col("__r.services"))
    df = df.withColumns({
        "products": clean_products(F.concat(F.col("__r.products"), rescued), text), "services": F.slice(clean_services(services, text), 1, 5),
        "technologies": infer_technologies(text, clean_technologies(F.col("__r.technologies"))), "use_cases": clean_use_cases(F.col("__r.use_cases")),
    })
    df = df.withColumns({
        "industry": validate_industry(clean_string(F.col("__r.industry"), 6), F.col("technologies"), text),
        "products": F.when(F.size("products") == 0, rescue_products(text)).otherwise(F.col("products")),
        "use_cases": F.when(F.size("use_cases") < 3, append_missing(F.col("use_cases"), infer_use_cases(text), 6)).otherwise(F.slice("use_cases", 1, 6)),
    })
    named = F.size(F.filter("products", lambda p: (F.size(words(p)) >= 2) | F.exists(words(p), brand_token)))
    df = df.withColumn("confidence", extraction_confidence(named, F.col("products"), F.col("technologies"), F.col("industry"), F.col("use_cases"), text))
    return df.withColumn("technologies", F.slice("technologies", 1, 10)).drop("__r")


def too_short(text: Column, least: int = 100) -> Column:
    return F.length(strip(F.coalesce(text, F.lit("")))) < least


def hopeless(confidence: Column, technologies: Column, industry: Column) -> Column:
    """Nothing was extracted."""
    return (confidence == 0) & (F.size(technologies) == 0) & (F.coalesce(industry, F.lit("")) == "")


def grounded(items: Column, text: Column) -> Column:
    """Items that occur in the text, without case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(items, lambda x: low.contains(F.lower(x)))
