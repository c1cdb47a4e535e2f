"""Phrases against counting by slices of word lists."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlens.llm import blocks, collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least=10, longest=3, cover=50, most=2000):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cand = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    gone = set()
    for (lang, p), a in cand.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                if 100 * a >= cover * f[lang, p[i : i + m]]:
                    gone.add((lang, p[i : i + m]))
    rows = defaultdict(list)
    for (lang, p), a in cand.items():
        if (lang, p) not in gone:
            score, _, l, r = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            rows[lang].append((-score, -a, " ".join(p).encode(), l, r))
    out = []
    for lang, found in rows.items():
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def got(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


def corpus(seed, n=150, words=("a", "B", "cc", "é", "日本", "x-y", "\x1c", "D'", "ß", "e f")):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(60)):
            parts.append(rng.choice(words[: 3 + rng.randrange(len(words) - 2)]))
            parts.append(rng.choice([" ", " ", " ", " ", "  ", "\t", ", ", ".", "\n", "!? ", ":"]))
        docs.append(("".join(parts), rng.choice(["en", "de", None, "", "und"])))
    return docs + [(None, "en"), ("", None), ("...,,,", "fr"), ("a b", "only"), docs[0], docs[0], ("a a " * 3000, "en"), ("a b c " * 500, "de")]


@pytest.mark.parametrize("lot", [1 << 21, 64])
def test_collocations(spark, monkeypatch, lot):
    monkeypatch.setattr(collocations, "LOT", lot)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 700)
    docs = corpus(lot)
    df = spark.createDataFrame(docs, "text string, lang string").repartition(3)
    assert got(collocations.collocations(df)) == brute(docs) != []
    odd = df.select("*", *(F.lit(None).cast("string").alias(c) for c in ("phrase", "f", "words", "doc_id", "block", "carry", "a", "of", "part", "score")))
    assert got(collocations.collocations(odd, least=3, cover=80, most=7)) == brute(docs, 3, 3, 80, 7)
    assert got(collocations.collocations(df, least=4, longest=2)) == brute(docs, 4, 2)


def test_empty(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(df).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None)], "text string, lang string")).count() == 0
    with pytest.raises(ValueError):
        collocations.phrase_counts(df, longest=4)


def test_bitmaps_shift_over_elements():
    at = np.array([0, 6, 7, 8, 15, 16, 31])
    maps = collocations.Bitmaps.of(np.zeros(len(at), np.int64), at)
    moved = maps.shifted()
    places = sorted(int(e) * 8 + b for e, bits in zip(moved.element, moved.bits, strict=True) for b in range(8) if bits >> b & 1)
    assert places == [a + 1 for a in at]


def test_phrases_do_not_leave_their_piece(spark):
    docs = [("one two. three four", "en")] * 10 + [("one two three\x0bfour", "en")] * 10
    counts = {r["phrase"]: r["f"] for r in collocations.phrase_counts(spark.createDataFrame(docs, "text string, lang string")).filter("words > 1").collect()}
    assert counts == {"one two": 20, "two three": 10, "three four": 10, "one two three": 10}


def test_large_counts_are_exact(spark, monkeypatch):
    big = 3_000_000_000
    rows = [("en", 0, "", 10 * big), ("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 2, "a b", big - 2)]
    monkeypatch.setattr(collocations, "phrase_counts", lambda *_: spark.createDataFrame(rows, "lang string, words long, phrase string, f long"))
    assert got(collocations.collocations(spark.range(0))) == [("en", 1, "a b", big - 2, big, big - 1, 10 * big, 1_000_000 * (big - 2) ** 2 // (big * (big - 1)))]
