"""Base counts against plain Python, decoding against a loop, and held-out documents."""

import itertools
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlens.llm import blocks, line_rules, quality
from rosterlens.llm.line_rules import EDGES, FEATURES, Field, Lines

SPACE = "[^\x20\x09-\x0d]+"
TEXTS = [None, "", "  \n\n ", "a", "a b c a b c", "x " * 200, "line one\nline one\n line one\n\nline one", "é|# <b>日本 語 $5 %\r\nß\r\nß", "a b\nc a\nb c\n" * 30, "\n" * 5000 + "end", "one two three four. " * 9 + "\nAND MORE!!"]


def base(text):
    text = text or ""
    words = re.findall(SPACE, text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(SPACE, x)]
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed, len(lines)


def field(seed):
    rng = np.random.default_rng(seed)
    return Field(rng.integers(-9, 9, FEATURES) * line_rules.ONE // 8, rng.integers(-9, 9, (2, 2)) * line_rules.ONE // 4)


def test_base_counts(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 900)
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice(["ab", "c", "É", "#", "zz|", " ", " ", "\n", "\t", "\x0b", "\x1c"]) for _ in range(rng.randrange(400))) for _ in range(60)]
    rows = [(i if i != 3 else None, t) for i, t in enumerate([*texts, TEXTS[4]])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted(map(tuple, line_rules.judge(df, field(1)).drop("kept", "n_content_lines", "content_words").collect()), key=repr)
    assert got == sorted(((i, *base(t)) for i, t in rows), key=repr)
    odd = df.select("*", *(F.lit(1).alias(c) for c in ("n_words", "kept", "id", "line", "content", "label")))
    assert sorted(map(repr, line_rules.judge(odd, field(1)).collect())) == sorted(map(repr, line_rules.judge(df, field(1)).collect()))
    assert line_rules.judge(df.filter("false"), field(1)).count() == 0


def viterbi(f, bins):
    emit = f.scores(bins).tolist()
    best = [(emit[0][y], (y,)) for y in range(2)]
    for e in emit[1:]:
        new = []
        for y in range(2):
            from_ = 1 if best[1][0] + int(f.steps[1, y]) > best[0][0] + int(f.steps[0, y]) else 0
            new.append((best[from_][0] + int(f.steps[from_, y]) + e[y], (*best[from_][1], y)))
        best = new
    return best[best[1][0] > best[0][0]]


def test_decoding_is_viterbi():
    rng = np.random.default_rng(2)
    width = np.array([len(e) + 1 for e in EDGES.values()])
    for seed, sizes in enumerate([(1,), (1, 2, 3, 4, 5), (9, 1, 1, 17), (300, 2, 64)]):
        f = field(seed)
        doc = np.repeat(np.arange(len(sizes)) * 3, sizes)
        bins = np.stack([rng.integers(0, w, len(doc)) for w in width], 1) + np.cumsum(width) - width
        marks = f.decode(doc, bins)
        for d in set(doc.tolist()):
            assert tuple(marks[doc == d]) == viterbi(f, bins[doc == d])[1]
        for d in (d for d in set(doc.tolist()) if (doc == d).sum() <= 5):
            own = bins[doc == d]
            score = lambda m: sum(int(e[y]) for e, y in zip(f.scores(own), m, strict=True)) + sum(int(f.steps[a, b]) for a, b in itertools.pairwise(m))  # noqa: E731, B023
            assert max(map(score, itertools.product(range(2), repeat=len(own)))) == viterbi(f, own)[0] == score(tuple(marks[doc == d]))
    assert (Field.none().decode(np.zeros(9, int), np.zeros((9, len(EDGES)), int)) == 0).all(), "ties are content"


def test_fit_reaches_the_likelihoods_top():
    """Expected counts equal those seen, up to the prior, with marginals summed over all marks by brute force."""
    rng = np.random.default_rng(4)
    width = np.array([len(e) + 1 for e in EDGES.values()])
    run = np.repeat(np.arange(12), rng.integers(1, 5, 12))
    bins = np.stack([rng.integers(0, w, len(run)) for w in width], 1) + np.cumsum(width) - width
    y = rng.integers(0, 2, len(run))
    f = Field.fit(bins, run, y, iterations=600, decay=1.0)
    w, steps = f.weights / line_rules.ONE, f.steps / line_rules.ONE
    gradient, pairs = np.zeros(FEATURES), np.zeros((2, 2))
    for r in range(12):
        own, seen = bins[run == r], y[run == r]
        weigh = lambda m: np.exp(sum(w[b].sum() for b, k in zip(own, m, strict=True) if k) + sum(steps[a, b] for a, b in itertools.pairwise(m)))  # noqa: E731, B023
        every = list(itertools.product(range(2), repeat=len(own)))
        total = sum(map(weigh, every))
        for m, p in [(tuple(seen), 1.0), *((m, -weigh(m) / total) for m in every)]:
            for b, k in zip(own, m, strict=True):
                gradient[b] += p * k
            for a, b in itertools.pairwise(m):
                pairs[a, b] += p
    assert np.abs(gradient - w).max() < 1e-2 and np.abs(pairs - steps).max() < 1e-2


def test_marks(spark):
    docs = spark.createDataFrame([(1, "Some plain text here.\n\nHome | News | Contact | About\n"), (2, None)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["line"]) for r in line_rules.marks(docs, Field.none()).collect()) == [(1, 0), (1, 2)]


def test_without_labels(spark):
    docs = spark.createDataFrame([(i, f"word{i} " + " ".join(f"w{i}{k}" for k in range(60))) for i in range(9)], "doc_id long, text string")
    for labels in ([], [(1, 1, 0), (2, 1, 0)], [(None, None, 1), (1, None, 0)]):
        marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        assert all(r["kept"] for r in line_rules.classify(docs, marks).collect())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables here")
def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = labels.filter(quality.fold(F.col("doc_id"), 5, 0)).select("doc_id", "quality")
    rows = line_rules.classify(docs, labels).join(held, "doc_id").filter("not base_failed").collect()
    good, bad = [r for r in rows if r["quality"] == 1], [r for r in rows if r["quality"] == 0]
    assert len(bad) > 3 and all(r["kept"] for r in good) and sum(not r["kept"] for r in bad) >= 0.8 * len(bad)
