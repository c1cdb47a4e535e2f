"""Product records from prose: names, specifications, and the assembled company record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..functions.arrays import contains_any, distinct_ignoring_case, let, split_values, strings
from .lexicon import first_match, words_present

#: Patterns of names and of what follows or introduces a product. Results hang on them.
NAME = r"\b([A-Z][A-Za-z0-9&+\-]*(?:\s+[A-Z][A-Za-z0-9&+\-]*)*)\b"
ITEMS = "array<struct<name: string, specifications: string>>"
_PHRASE = r"[A-Z][A-Za-z0-9][A-Za-z0-9\-]*(?:\s+[A-Z][A-Za-z0-9][A-Za-z0-9\-]*){0,4}"
BEFORE_WORD = rf"\b({_PHRASE})(?=\s+(?:platform\b|solution\b|software\b|system\b|suite\b|tool\b|product\b|service\b|app\b|api\b|sdk\b|is\b|are\b|enables\b|helps\b|allows\b|provides\b|offers\b|delivers\b|powers\b|automates\b))"
INTRODUCED = rf"(?:[Oo]ur|[Mm]eet|[Ii]ntroducing|[Pp]resenting|[Ll]aunch(?:ing)?)\s+({_PHRASE})"


def _item(name: Column, specs: Column) -> Column:
    return F.struct(name.alias("name"), specs.alias("specifications"))


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9&+\-]+"), F.lit(0))


def plausible_name(name: Column) -> Column:
    tokens = _tokens(name)
    return (
        ~name.isin("It", "Its", "This", "That", "These", "Those", "The") & F.length(name).between(3, 60) & F.size(tokens).between(2, 6)
        & F.exists(tokens, lambda t: t.rlike("^[A-Z]")) & ~F.forall(tokens, lambda t: F.lower(t).isin(*L.GENERIC_PRODUCT_TOKENS))
    )


def _own_specs(sentence: Column, name: Column) -> Column:
    at = F.instr(sentence, name)
    cut = F.concat(F.substring(sentence, F.lit(1), at - 1), F.substring(sentence, at + F.length(name), F.length(sentence)))
    rest = T.strip_chars(F.when(at > 0, cut).otherwise(sentence), " ,.;:-")
    return F.when(contains_any(F.lower(rest), L.SPEC_HINTS), T.spec_text(rest)).otherwise("")


def _neighbour(line: Column) -> Column:
    line = T.normal_line(line)
    low = F.lower(line)
    hit = contains_any(low, L.SPEC_HINTS) | low.rlike("^(?:it |it\\.|this |these )")
    return F.when(hit, T.spec_text(line)).otherwise("")


def structured_products(text: Column, most: int = 6) -> Column:
    """Named products with specifications from their own and the neighbouring sentence."""
    return let(T.sentences(F.coalesce(text, F.lit("")), T.SENTENCE_ON_LINE), lambda parts: _structured(parts, most))


def _structured(parts: Column, most: int) -> Column:
    def of(s: Column, i: Column) -> Column:
        names = F.filter(F.transform(F.regexp_extract_all(s, F.lit(NAME), F.lit(1)), T.normal_line), plausible_name)
        after, before = _neighbour(F.coalesce(F.get(parts, i + 1), F.lit(""))), _neighbour(F.when(i > 0, F.get(parts, i - 1)).otherwise(""))
        near = F.when(after != "", after).otherwise(before)

        def one(name: Column) -> Column:
            both = distinct_ignoring_case(F.filter(F.array(_own_specs(s, name), near), lambda x: x != ""))
            return _item(name, T.spec_text(F.array_join(both, ", "), 26, 180))

        found = F.filter(F.transform(names, one), lambda x: x["specifications"] != "")
        return F.when(contains_any(F.lower(s), L.PRODUCT_SENTENCE_WORDS), found).otherwise(F.array().cast(ITEMS))

    found = F.flatten(F.transform(parts, of))
    return F.slice(distinct_ignoring_case(found, lambda x: F.concat(F.lower(x["name"]), F.lit("\x01"), F.lower(x["specifications"]))), 1, most)


def collapse_repeats(specs: Column) -> Column:
    return F.array_join(distinct_ignoring_case(split_values(specs, r"[,;]\s*")), ", ")


def finalized(items: Column, most: int = 6) -> Column:
    """Plausible, distinct names with tidy specifications."""
    tidy = F.transform(items, lambda x: _item(T.normal_line(x["name"]), collapse_repeats(T.spec_text(x["specifications"]))))
    return F.slice(distinct_ignoring_case(F.filter(tidy, lambda x: plausible_name(x["name"])), lambda x: F.lower(x["name"])), 1, most)


def meaningful_product(value: Column) -> Column:
    tokens = F.transform(F.regexp_extract_all(value, F.lit("[A-Za-z0-9-]+"), F.lit(0)), F.lower)
    return (F.size(tokens) > 0) & ~F.get(tokens, F.lit(0)).isin("the", "this", "that", "these", "those", "it") & ~F.forall(tokens, lambda t: t.isin("solution", "system", "platform"))


def product_bigrams(text: Column, most: int = 5, low: Column | None = None) -> Column:
    """Words before a product term, and the terms themselves."""
    text = F.coalesce(text, F.lit(""))
    found = let(F.regexp_extract_all(text, F.lit("[A-Za-z][A-Za-z0-9-]+"), F.lit(0)), lambda tokens: _bigrams(tokens, most))
    return F.when(contains_any(F.lower(text) if low is None else low, L.PRODUCT_TERMS), found).otherwise(strings(()))


def _bigrams(tokens: Column, most: int) -> Column:
    return let(F.struct(tokens.alias("t"), F.transform(tokens, lambda t: F.lower(t).isin(*L.PRODUCT_TERMS)).alias("term")), lambda x: _beside_terms(x["t"], x["term"], most))


def _beside_terms(tokens: Column, term: Column, most: int) -> Column:
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(tokens) - 2, F.lit(0))), lambda i: (F.get(term, i) | F.get(term, i + 1)) & (i <= F.size(tokens) - 2))
    found = F.flatten(F.transform(at, lambda i: F.concat(
        F.when(F.get(term, i + 1), F.array(F.concat(F.get(tokens, i), F.lit(" "), F.get(tokens, i + 1)))).otherwise(strings(())),
        F.when(F.get(term, i), F.array(F.get(tokens, i))).otherwise(strings(())),
    )))
    return F.slice(distinct_ignoring_case(F.filter(found, meaningful_product)), 1, most)


def titled_products(names: Column, most: int = 6) -> Column:
    """Names of two to six words in title case, without specifications."""
    titled = F.filter(F.transform(distinct_ignoring_case(names), T.title_tokens), lambda t: F.size(T.words(t)).between(2, 6))
    return F.slice(F.transform(titled, lambda t: _item(t, F.lit(""))), 1, most)


def record_technologies(text: Column, low: Column | None = None) -> Column:
    found = words_present(F.lower(text) if low is None else low, L.RECORD_TECH_TERMS)
    return T.blank_to_null(F.array_join(F.transform(found, lambda t: F.when(t == "ai", "AI").otherwise(F.initcap(t))), ", "))


def products_json(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.to_json(items))


def company_record(df: DataFrame, company: str = "company", website: str = "website", text: str = "text", model: str | None = None) -> DataFrame:
    """The record of each company, model values before native ones.

    ``model`` names a struct column with products and technologies (arrays) and industry,
    already grounded; without it everything is native.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    # The text is lowered once, and cut into sentences only where it holds a word that is looked for.
    low = F.col("__low")
    section = T.sentences_with(body, L.SECTION_WORDS, 80, low)
    source = T.extraction_text(let(section, lambda s: F.when(F.size(s) > 0, F.array_join(s, " ")).otherwise(body)))
    listed = F.col(f"{model}.products") if model else strings(())
    listed = F.when(F.size(F.coalesce(listed, strings(()))) > 0, listed).otherwise(product_bigrams(body, low=low))
    items = finalized(let(structured_products(source), lambda named: F.when(F.size(named) > 0, named).otherwise(titled_products(listed))))
    own = F.col(f"{model}.industry") if model else F.lit(None).cast("string")
    tech = T.blank_to_null(F.array_join(F.col(f"{model}.technologies"), ", ")) if model else F.lit(None).cast("string")
    specs = T.blank_to_null(F.array_join(distinct_ignoring_case(F.slice(F.filter(F.transform("__items", lambda x: x["specifications"]), lambda s: s != ""), 1, 5)), ", "))
    df = df.withColumn("__low", F.lower(body)).withColumn("__items", items)
    return df.select(
        T.blank_to_null(F.col(company)).alias("company_name"), T.blank_to_null(F.col(website)).alias("website"),
        F.coalesce(T.blank_to_null(own), first_match(low, L.FIRST_MATCH_INDUSTRIES)).alias("industry"), products_json(F.col("__items")).alias("products"),
        F.coalesce(tech, record_technologies(body, low)).alias("technologies"), F.coalesce(specs, T.spec_sentence(body, low)).alias("product_specifications"),
        T.price_bucket(body, low).alias("price_range"), T.email(body).alias("contact_email"), T.phone(body).alias("phone"), T.address(body, low).alias("address"), T.description(body).alias("description"),
    )


# ------------------------------------------------------------------- the mixed extractor


def _product_like(name: Column) -> Column:
    return (F.size(T.words(name)) >= 2) | name.rlike(r"^[A-Z0-9\-]*[A-Z][A-Z0-9\-]*\z") | name.rlike(r"^[A-Z].*[A-Z]")


def pattern_products(text: Column, most: int = 5, low: Column | None = None) -> Column:
    """Products by what follows or introduces a capitalised phrase, else by the head of a product sentence."""
    text = F.coalesce(text, F.lit(""))
    lead = "|".join(L.LEADING_WORDS)
    good = lambda n: F.length(n).between(4, 60) & ~F.lower(n).isin(*L.GENERIC_SINGLE) & _product_like(n)
    first = F.transform(F.regexp_extract_all(text, F.lit(BEFORE_WORD), F.lit(1)), lambda n: F.array_join(T.words(F.regexp_replace(n, rf"^(?:(?:{lead})(?:\s+|\z))+", "")), " "))
    second = F.transform(F.regexp_extract_all(text, F.lit(INTRODUCED), F.lit(1)), T.strip)
    hits = F.filter(F.concat(first, second), good)

    def head(s: Column) -> Column:
        w = F.slice(T.words(s), 1, 8)
        stop = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(F.lower(F.get(w, i)), r"[.,;:]+\z", "").isin(*L.NAME_STOP))
        return T.strip_chars(F.array_join(F.slice(w, F.lit(1), F.coalesce(F.get(stop, F.lit(0)), F.lit(8))), " "), " -|,;:.!?")

    fit = T.holding(T.sentences(text), F.lower(text) if low is None else low, L.HYBRID_PRODUCT_HINTS, lambda s: ~F.lower(s).rlike("^(?:" + "|".join(L.SKIP_PREFIXES) + ")"))
    heads = F.filter(F.transform(fit, head), lambda p: F.length(p).between(6, 60))
    return F.slice(F.array_distinct(let(hits, lambda h: F.when(F.size(h) > 0, h).otherwise(heads))), 1, most)


def spec_lines(text: Column, most: int = 5, low: Column | None = None) -> Column:
    text = F.coalesce(text, F.lit(""))
    fit = lambda s: F.length(s).between(15, 130)
    low = F.lower(text) if low is None else low
    lines = split_values(text, "[\n•]")
    hinted, other = T.holding(lines, low, L.HYBRID_SPEC_HINTS, fit), T.holding(lines, low, L.HYBRID_SPEC_VERBS, fit)
    return F.slice(F.array_distinct(let(hinted, lambda h: F.when(F.size(h) > 0, h).otherwise(other))), 1, most)


def mixed_profile(df: DataFrame, text: str = "text", model_summary: Column | None = None) -> DataFrame:
    """``df`` with products, specifications, technologies, contacts, a summary and confidence labels.

    Where the summary is weak or nothing was found, a model's summary takes its place, or,
    without one, the longer extractive summary.
    """
    df = df.withColumn("__body", T.strip(F.coalesce(F.col(text), F.lit(""))))
    body, low = F.col("__body"), F.col("__low")
    df = df.withColumn("__low", F.lower(body)).withColumns({
        "products": pattern_products(body, low=low), "product_specifications": spec_lines(body, low=low), "technologies": words_present(low, L.HYBRID_TECH_TERMS),
        "price_range": T.prices(body), "contact_email": T.email(body), "phone": T.phone(body), "summary": T.fast_summary(body),
    })
    joined = lambda c: F.array_join(c, " ")
    given = lambda c: F.when(F.col(c).isNotNull(), "high").otherwise("low")
    first = T.confidence_label(F.col("summary"), 45, 140)
    other = T.summary(body, 320)
    if model_summary is not None:
        other = F.coalesce(T.blank_to_null(T.strip(model_summary)), other)
    weak = ((first == "low") | ((F.size("products") == 0) & (F.size("product_specifications") == 0))) & (other != "")
    df = df.withColumn("confidence", F.struct(
        F.when(weak, "medium").otherwise(first).alias("summary"), T.confidence_label(joined("products"), 5, 20).alias("products"),
        T.confidence_label(joined("product_specifications"), 8, 35).alias("product_specifications"), given("price_range").alias("price_range"),
        given("contact_email").alias("contact_email"), given("phone").alias("phone"), T.confidence_label(joined("technologies"), 3, 14).alias("technologies"),
    ))
    df = df.withColumn("summary", F.when(weak, other).otherwise(F.col("summary")))
    return df.withColumn("technologies", F.when(F.col("confidence.technologies") == "low", strings(())).otherwise(F.slice("technologies", 1, 6))).drop("__body", "__low")
