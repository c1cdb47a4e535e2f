"""Array helpers. Results keep the order of first appearance."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

STRINGS = "array<string>"


#: Word lists beyond this are one array literal instead of a chain of tests; plans stay small.
LONG = 10
MARK = "\x1f"


def word_list(words: Iterable[str]) -> Column:
    """An array literal of words, folded from one string."""
    return F.split(F.lit(MARK.join(words)), MARK)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, also where lambdas refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strings(items: Iterable[str]) -> Column:
    """An array literal of strings, typed even when empty."""
    return F.array(*(F.lit(x) for x in items)).cast(STRINGS)


def distinct_ignoring_case(items: Column, key: Callable[[Column], Column] = F.lower) -> Column:
    """The first of those items whose key is the same; with a key, of any type of item."""
    def pick(pair: Column) -> Column:
        return F.transform(F.transform(F.array_distinct(pair["k"]), lambda k: F.array_position(pair["k"], k)), lambda at: F.element_at(pair["v"], at.cast("int")))

    return let(items, lambda v: let(F.struct(v.alias("v"), F.transform(v, key).alias("k")), pick))


def split_values(text: Column, pattern: str = ",") -> Column:
    """Stripped, non-empty parts."""
    from .text import strip

    return F.filter(F.transform(F.split(text, pattern), strip), lambda x: x != "")


def as_list(value: Column, kind: str) -> Column:
    """A list of stripped, non-empty strings from a column of type ``kind``: a list, or text with commas."""
    from .text import strip

    if kind.startswith("array"):
        return F.filter(F.transform(F.coalesce(value.cast(STRINGS), strings(())), strip), lambda x: x != "")
    return split_values(F.coalesce(value.cast("string"), F.lit("")))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Whether any of the words is a substring."""
    words = list(words)
    if not words:
        return F.lit(False)
    # In a lambda, what stands for the text would be evaluated anew for each word.
    if len(words) > LONG:
        return let(text, lambda t: F.exists(word_list(words), lambda w: t.contains(w)))

    def chain(t: Column) -> Column:
        out = t.contains(words[0])
        for w in words[1:]:
            out = out | t.contains(w)
        return out

    return let(text, chain) if len(words) > 1 else chain(text)


def replace_each(text: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Replaces one string after the other; those that a text lacks cost it one look."""
    table = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs))
    return F.aggregate(table, text, lambda acc, p: F.when(acc.contains(p["a"]), F.replace(acc, p["a"], p["b"])).otherwise(acc))


def first_distinct(items: Column, key: Callable[[Column], Column], fit: Callable[[Column], Column], most: int, make: Callable[[Column], Column] = lambda x: x) -> Column:
    """The first ``most`` of the made, fit strings whose key is new; what stands behind them is not looked at."""
    zero = F.struct(strings(()).alias("k"), strings(()).alias("v"))

    def add(acc: Column, x: Column) -> Column:
        return let(key(x), lambda k: F.when(F.array_contains(acc["k"], k), acc).otherwise(F.struct(F.concat(acc["k"], F.array(k)).alias("k"), F.concat(acc["v"], F.array(x)).alias("v"))))

    def fold(acc: Column, x: Column) -> Column:
        return F.when(F.size(acc["v"]) >= most, acc).otherwise(let(make(x), lambda y: F.when(fit(y), add(acc, y)).otherwise(acc)))

    return F.aggregate(items, zero, fold)["v"]


def first_fit(items: Column, fit: Callable[[Column], Column], most: int) -> Column:
    """The first ``most`` strings that fit; what stands behind them is not looked at."""
    return F.aggregate(items, strings(()), lambda acc, x: F.when(F.size(acc) >= most, acc).when(fit(x), F.concat(acc, F.array(x))).otherwise(acc))


def count_present(text: Column, words: Iterable[str]) -> Column:
    """How many of the words are substrings."""
    words = list(words)
    if len(words) > LONG:
        return F.size(let(text, lambda t: F.filter(word_list(words), lambda w: t.contains(w))))
    out = F.lit(0)
    for w in words:
        out = out + text.contains(w).cast("int")
    return out


def append_missing(first: Column, second: Column, most: int) -> Column:
    """Items of ``first``, then those of ``second`` that it lacks."""
    return F.slice(F.array_distinct(F.concat(first, second)), 1, most)


def without(items: Column, unwanted: Iterable[str]) -> Column:
    """Items that, lowered, aren't among the unwanted."""
    unwanted = sorted({x.lower() for x in unwanted})
    return F.filter(items, lambda x: ~F.lower(x).isin(unwanted))
