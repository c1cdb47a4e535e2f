"""Text functions, Column to Column. White space and word characters are Unicode's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from .arrays import contains_any, distinct_ignoring_case, first_distinct, first_fit, let, split_values, strings

SENTENCE = r"(?U)(?<=[.!?])\s+|\n+"
SENTENCE_ON_LINE = r"(?U)(?<=[.!?])\s+"
#: Patterns of contacts and prices. Results hang on them.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?U)\+?[0-9][0-9\s().-]{7,}[0-9]"
PRICE = r"[$₹]\s?[0-9][0-9,]*(?:\.[0-9]{1,2})?"
#: The characters of ``(?U)\s``.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def strip_chars(text: Column, chars: str) -> Column:
    return F.trim(text, F.lit(chars))


def rstrip_chars(text: Column, chars: str) -> Column:
    return F.rtrim(text, F.lit(chars))


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def words(text: Column) -> Column:
    """Parts between white space; none of an empty text."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def sentences(text: Column, pattern: str = SENTENCE) -> Column:
    return F.filter(F.transform(F.split(text, pattern), strip), lambda s: s != "")


def clean_text(text: Column) -> Column:
    """Word characters and plain punctuation, single spaces."""
    return collapse(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[^\w\s.,;:!?()'\"/-]", " "))


def quality_flag(text: Column, good: int = 1000, low: int = 200) -> Column:
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n >= good, "GOOD").when(n >= low, "LOW").otherwise("FAILED")


def cut_at_word(text: Column, most: int) -> Column:
    """The first ``most`` characters up to the last space."""
    return strip(F.regexp_replace(F.substring(text, 1, most), r" [^ ]*\z", ""))


def summary(text: Column, most: int = 350, least: int = 40) -> Column:
    """The first three sentences of some length; else the beginning of the text."""
    text = F.coalesce(text, F.lit(""))
    chosen = F.array_join(first_fit(sentences(text), lambda s: F.length(s) >= least, 3), " ")
    return let(chosen, lambda chosen: F.when(chosen != "", rstrip_chars(F.substring(chosen, 1, most), " ,;:")).otherwise(cut_at_word(text, most)))


def summary_or_opening(text: Column) -> Column:
    """A summary; if it is short, the opening up to its last full stop, if that is long enough."""
    main = summary(text)
    opening = F.regexp_extract(F.substring(F.coalesce(text, F.lit("")), 1, 300), r"(?s)^(.*\.)", 1)
    opening = F.when(opening != "", opening).otherwise(F.substring(F.coalesce(text, F.lit("")), 1, 300))
    return F.when(F.length(main) >= 50, main).when(F.length(strip(opening)) > 40, strip(opening)).otherwise("")


def _opening_sentences(text: Column, most: int, least: int) -> Column:
    chosen = collapse(F.array_join(first_fit(sentences(F.coalesce(text, F.lit(""))), lambda s: F.length(s) >= least, 3), " "))
    return let(chosen, lambda chosen: F.when(chosen == "", "").otherwise(F.concat(rstrip_chars(F.substring(chosen, 1, most), " ,;:"), F.lit("."))))


def fast_summary(text: Column) -> Column:
    return _opening_sentences(text, 320, 40)


def short_summary(text: Column, most: int = 420) -> Column:
    return _opening_sentences(text, most, 0)


def two_sentence_summary(text: Column) -> Column:
    """The first two parts between full stops that are over 40 characters."""
    text = F.coalesce(text, F.lit(""))
    kept = F.transform(F.filter(F.split(text, r"\."), lambda s: F.length(s) > 40), strip)
    return F.when(F.length(text) < 50, "No meaningful content available.").otherwise(F.concat(F.array_join(F.slice(kept, 1, 2), ". "), F.lit(".")))


def signature(text: Column, tokens: int) -> Column:
    """The first words of a text without case and punctuation."""
    plain = F.regexp_replace(F.lower(text), r"(?U)[^a-z0-9\s]", "")
    return F.array_join(F.slice(words(plain), 1, tokens), " ")


def normal_line(text: Column) -> Column:
    return strip_chars(collapse(F.coalesce(text, F.lit(""))), " ,.;:-")


def extraction_text(text: Column, max_words: int = 22, most: int = 4, tokens: int = 10) -> Column:
    """Up to four distinct short lines."""
    fit = lambda s: (s != "") & (F.size(words(s)) <= max_words)
    return F.array_join(first_distinct(sentences(F.coalesce(text, F.lit(""))), lambda s: signature(s, tokens), fit, most, normal_line), "\n")


def spec_text(text: Column, max_words: int = 20, max_chars: int = 140) -> Column:
    compact = strip_chars(F.array_join(F.slice(words(text), 1, max_words), " "), " ,.;:-")
    return strip_chars(F.substring(compact, 1, max_chars), " ,.;:-")


def title_tokens(text: Column) -> Column:
    """Tokens with a first capital; those in capitals stay."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z0-9&+\-]+"), F.lit(0))
    upper = lambda t: (t == F.upper(t)) & (t != F.lower(t))
    return F.array_join(F.transform(tokens, lambda t: F.when(upper(t), t).otherwise(F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 1 << 20))))), " ")


def description(text: Column) -> Column:
    kept = first_fit(sentences(F.coalesce(text, F.lit("")), SENTENCE_ON_LINE), lambda s: F.size(words(s)) >= 6, 2)
    return blank_to_null(F.substring(F.array_join(kept, " "), 1, 500))


def confidence_label(value: Column, low: int, high: int) -> Column:
    n = F.length(strip(F.coalesce(value, F.lit(""))))
    return F.when(n >= high, "high").when(n >= low, "medium").otherwise("low")


def with_full_stop(text: Column) -> Column:
    text = strip(F.coalesce(text, F.lit("")))
    return F.when((text == "") | text.rlike(r"[.!?]\z"), text).otherwise(F.concat(text, F.lit(".")))


def holding(parts: Column, low: Column, keywords: tuple[str, ...], fit: Callable[[Column], Column] | None = None) -> Column:
    """Parts of a text that hold a keyword, without case, and fit; the text is cut up only if ``low``, all of it in lower case, holds one."""
    found = F.filter(parts, lambda s: contains_any(F.lower(s), keywords) if fit is None else contains_any(F.lower(s), keywords) & fit(s))
    # Which letter a capital becomes may hang on its neighbours, outside of ASCII.
    return F.when(contains_any(low, keywords), found).otherwise(strings(())) if all(k.isascii() for k in keywords) else found


def sentences_with(text: Column, keywords: tuple[str, ...], most: int | None = None, low: Column | None = None) -> Column:
    """Sentences that hold a keyword, without case. ``low``: the text in lower case, if it is at hand."""
    text = F.coalesce(text, F.lit(""))
    found = holding(sentences(text), F.lower(text) if low is None else low, keywords)
    return F.slice(found, 1, most) if most else found


# ------------------------------------------------------------------------ single values


def email(text: Column) -> Column:
    return blank_to_null(F.when(text.contains("@"), F.regexp_extract(text, EMAIL, 0)).otherwise(""))


def phone(text: Column) -> Column:
    return blank_to_null(strip(F.regexp_extract(F.coalesce(text, F.lit("")), PHONE, 0)))


def prices(text: Column, most: int = 3) -> Column:
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PRICE), F.lit(0)), strip)
    return blank_to_null(F.array_join(F.slice(F.array_distinct(found), 1, most), ", "))


def price_bucket(text: Column, low: Column | None = None) -> Column:
    low = F.lower(text) if low is None else low
    return (
        F.when(contains_any(low, ("enterprise", "premium", "high-end")), "High-end")
        .when(contains_any(low, ("affordable", "low cost", "budget")), "Budget")
        .when(contains_any(low, ("$", "pricing", "quote")), "Quoted")
    )


def address(text: Column, low: Column | None = None) -> Column:
    """The first line with an address word and a digit."""
    text = F.coalesce(text, F.lit(""))
    fit = holding(split_values(text, r"\R"), F.lower(text) if low is None else low, L.ADDRESS_HINTS, lambda s: s.rlike("[0-9]"))
    return F.substring(F.get(fit, F.lit(0)), 1, 200)


def spec_sentence(text: Column, low: Column | None = None) -> Column:
    text = F.coalesce(text, F.lit(""))
    found = holding(sentences(text, SENTENCE_ON_LINE), F.lower(text) if low is None else low, L.SPEC_SENTENCE_WORDS)
    return F.substring(F.get(found, F.lit(0)), 1, 240)


def clean_string(text: Column, max_words: int = 5) -> Column:
    """The value, or "" if blank, too long or the start of a sentence."""
    value = strip(F.coalesce(text, F.lit("")))
    bad = (value == "") | (F.size(words(value)) > max_words) | F.lower(F.get(words(value), F.lit(0))).isin(*L.SENTENCE_STARTERS)
    return F.when(bad, "").otherwise(value)


# -------------------------------------------------------------------- dashboard strings


def safe_text(value: Column, fallback: str) -> Column:
    return F.coalesce(blank_to_null(strip(value.cast("string"))), F.lit(fallback))


def safe_score(value: Column) -> Column:
    number = value.cast("string").try_cast("double")
    return F.when(F.isnan(number) | (F.abs(number) == float("inf")), 0.0).otherwise(F.coalesce(number, F.lit(0.0)))


def format_score(value: Column) -> Column:
    return F.format_string("%.1f%%", safe_score(value))


def product_parts(text: Column) -> Column:
    """Name and features of a product string; null if blank."""
    parts = split_values(text, r"(?iU)[,;]\s*|\s+and\s+")
    return F.when(F.size(parts) > 0, F.struct(F.get(parts, F.lit(0)).alias("name"), F.slice(parts, 2, 1 << 20).alias("features")))


def specification_parts(text: Column, most: int = 8) -> Column:
    return F.slice(split_values(F.coalesce(text, F.lit("")), r"(?U)[,;]\s*|\.\s+"), 1, most)


def technology_parts(text: Column, most: int = 12) -> Column:
    return F.slice(split_values(F.coalesce(text, F.lit("")), r"(?iU)[,;]\s*|\s+and\s+"), 1, most)
