"""Keyword rules compiled to Column expressions, so that a whole rule set is one projection.

Words match as plain substrings of lowered text.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import count_present, let

Rule = tuple[str, str, int]


def occurrences(low: Column, word: str) -> Column:
    """Non-overlapping occurrences."""
    return ((F.length(low) - F.length(F.replace(low, F.lit(word), F.lit("")))) / len(word)).cast("int")


def factor(low: Column, strong: Sequence[str], medium: Sequence[str], strong_points: int, medium_points: int, extra: Column | None = None) -> Column:
    """Points for distinct words present, 100 at most."""
    points = count_present(low, strong) * strong_points + count_present(low, medium) * medium_points
    return F.least(points if extra is None else points + extra, F.lit(100))


def best_weight(low: Column, weights: Mapping[str, int]) -> Column:
    """The largest weight of a word present, else 0."""
    cases = [F.when(low.contains(w), F.lit(n)).otherwise(0) for w, n in weights.items()]
    return F.greatest(F.lit(0), *cases) if cases else F.lit(0)


#: Letters from the rarest to the most frequent one; strings that begin with a rare one are found sooner.
_RARE = "zqjxkvbpygwfmucldrhsnioate"


def gates(words: Sequence[str], least: int = 6) -> list[tuple[str, list[str]]]:
    """The words in groups by a string that all words of a group hold: what a text lacks needs one look a group."""
    parts = {w: {w[i:j] for i in range(len(w)) for j in range(i + least, len(w) + 1)} | {w} for w in dict.fromkeys(words)}
    rare = {c: i for i, c in enumerate(_RARE)}
    out = []
    while parts:
        n = Counter(p for own in parts.values() for p in own)
        gate = min(n, key=lambda p: (-n[p], rare.get(p[:1], len(rare)), -len(p), p))
        out.append((gate, [w for w, own in parts.items() if gate in own]))
        parts = {w: own for w, own in parts.items() if gate not in own}
    return out


def held_words(low: Column, words: Sequence[str]) -> Column:
    """The words that occur, in any order; for lists of more than a few."""
    rows = [{"gate": gate, "words": own} for gate, own in gates(words)]
    table = F.from_json(F.lit(json.dumps(rows)), "array<struct<gate: string, words: array<string>>>")
    return let(low, lambda t: F.flatten(F.transform(F.filter(table, lambda g: t.contains(g["gate"])), lambda g: F.filter(g["words"], lambda w: t.contains(w)))))


def label_scores(low: Column, rules: Sequence[Rule], most: int = 3, lone_words_twice: bool = False, held: Column | None = None) -> Column:
    """Array of (minus score, first rule, label) of labels with a score, best first.

    A label's score sums weight times occurrences, of which up to ``most`` count; ties go to
    the label whose rule matched first. ``lone_words_twice``: a word without a space needs
    two occurrences. ``held``: words that occur, those of other lists among them, if they are at hand.
    """
    # The rules are one literal array; what follows looks at rules that hit alone.
    rows = [{"o": i, "word": word, "label": label, "weight": weight, "least": 2 if lone_words_twice and " " not in word else 1} for i, (word, label, weight) in enumerate(rules)]
    table = F.from_json(F.lit(json.dumps(rows)), "array<struct<o: int, word: string, label: string, weight: int, least: int>>")

    def found(low: Column) -> Column:
        own = let(held_words(low, [w for w, _, _ in rules]) if held is None else held, lambda names: F.filter(table, lambda r: F.array_contains(names, r["word"])))
        count = lambda w, n: ((n - F.length(F.replace(low, w, F.lit("")))) / F.length(w)).cast("int")
        counted = lambda n: F.transform(own, lambda r: F.struct(r["o"].alias("o"), r["label"].alias("label"), r["weight"].alias("weight"), r["least"].alias("least"), count(r["word"], n).alias("n")))
        return F.filter(let(F.length(low), counted), lambda h: h["n"] >= h["least"])

    def score(hits: Column) -> Column:
        def one(label: Column) -> Column:
            own = F.filter(hits, lambda h: h["label"] == label)
            minus = F.aggregate(own, F.lit(0), lambda acc, h: acc - F.least(h["n"], F.lit(most)) * h["weight"])
            return F.struct(minus.alias("minus"), F.get(own, F.lit(0))["o"].alias("first"), label.alias("label"))

        labels = F.array_distinct(F.transform(hits, lambda h: h["label"]))
        return F.array_sort(F.filter(F.transform(labels, one), lambda e: e["minus"] < 0))

    # The text is lowered once and each word counted once, whatever refers to them.
    return let(low, lambda text: let(found(text), score))


def top_labels(low: Column, rules: Sequence[Rule], n: int, **options) -> Column:
    return F.transform(F.slice(label_scores(low, rules, **options), 1, n), lambda e: e["label"])


def best_label(low: Column, rules: Sequence[Rule], **options) -> Column:
    """The label with the highest score, else an empty string."""
    return F.coalesce(F.get(top_labels(low, rules, 1, **options), F.lit(0)), F.lit(""))


def first_match(low: Column, rules: Sequence[tuple[str, str]]) -> Column:
    out = None
    for word, label in rules:
        out = F.when(low.contains(word), label) if out is None else out.when(low.contains(word), label)
    return F.lit(None).cast("string") if out is None else out


def words_present(low: Column, words: Sequence[str]) -> Column:
    """The words that occur, in the order of the list."""
    return let(low, lambda t: F.filter(F.array(*(F.lit(w) for w in words)), lambda w: t.contains(w)))


def whole_word(word: str) -> str:
    """Pattern of a word that isn't part of another; for ``rlike``."""
    return rf"(?U)\b{re.escape(word)}\b"


#: Rule tables of up to so many words are compiled; the words of larger ones go through an automaton.
COMPILED = 64


def match_rules(docs: DataFrame, rules: DataFrame, text_col: str = "text", word_col: str = "word", id_col: str = "doc_id") -> DataFrame:
    """(id, columns of the rules) for each rule of a table whose word the lowered text holds.

    A table of any size: up to ``COMPILED`` distinct words become an array literal that each text is held
    against; more are found by ``automaton.occurrences``, in one pass over the texts that sends no text anywhere.
    """
    from .automaton import occurrences

    # A text is lowered, so a word with capitals is in none.
    rules = rules.filter((F.length(word_col) > 0) & (F.lower(word_col) == F.col(word_col)))
    words = rules.select(F.col(word_col).alias("__w")).distinct()
    few = [r["__w"] for r in words.limit(COMPILED + 1).collect()]
    if len(few) > COMPILED:
        hits = occurrences(docs, words, text_col, "__w", id_col).select(id_col, F.col("word").alias("__w"))
    else:
        low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
        hits = docs.select(id_col, F.explode(let(low, lambda x: words_present(x, few))).alias("__w")) if few else docs.select(id_col, F.lit("").alias("__w")).limit(0)
    return hits.join(rules, F.col("__w") == F.col(word_col)).drop("__w")
