"""Words in texts against plain counting, and the plan's single pass."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlens.operators import automaton as A


def brute(texts, words):
    out = {}
    for i, t in texts:
        low = (t or "").lower()
        for w in {w.lower() for w in words if w}:
            n = sum(low.startswith(w, k) for k in range(len(low)))
            if n:
                out[i, w] = (n, low.count(w))
    return out


def table(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string").repartition(3)


def words(spark, names):
    return spark.createDataFrame([(w,) for w in names], "word string")


@pytest.mark.parametrize(("segment", "entries"), [(1024, 1 << 24), (3, 1 << 24), (16, 1 << 12)])
def test_occurrences(spark, monkeypatch, segment, entries):
    monkeypatch.setattr(A, "SEGMENT", segment)
    monkeypatch.setattr(A, "ENTRIES", entries)
    monkeypatch.setattr(A, "READ", 300)
    rng = random.Random(segment)
    names = ["a", "aa", "aaa", "aba", "AB", "b a", "ß", "日本", "本", "é", "abababab", "", None, "zzz", "a" * 40, *("".join(rng.choice("abc é日") for _ in range(rng.randrange(1, 7))) for _ in range(40))]
    texts = [(i, "".join(rng.choice("aaabbc éÉ日本ß\n") for _ in range(rng.randrange(200)))) for i in range(60)] + [(90, None), (91, ""), (92, "a" * 3000), (93, "ab" * 900), (94, "AB" * 50)]
    got = {(r["doc_id"], r["word"]): (r["n"], r["n_apart"]) for r in A.occurrences(table(spark, texts), words(spark, names)).collect()}
    assert got == brute(texts, names)


def test_repeated_ids_and_other_columns(spark):
    docs = spark.createDataFrame([("x", "aba", 1), ("x", "b", 2), (None, "ab", 3)], "doc_id string, text string, word int")
    got = sorted(map(repr, A.occurrences(docs, words(spark, ["b", "ab"])).select("doc_id", "word", "n").collect()))
    assert got == sorted(["Row(doc_id='x', word='b', n=1)", "Row(doc_id='x', word='ab', n=1)", "Row(doc_id='x', word='b', n=1)", "Row(doc_id=None, word='ab', n=1)", "Row(doc_id=None, word='b', n=1)"])
    assert A.occurrences(docs, words(spark, [])).count() == 0
    assert A.occurrences(docs.filter("false"), words(spark, ["b"])).count() == 0


def test_label_totals(spark):
    rules = spark.createDataFrame([("robot", "ai", 5), ("Robot arm", "ai", 2), ("arm", "parts", 3), ("zip", "none", 9)], "word string, label string, weight int")
    docs = table(spark, [(1, "Robot arm, robot arm, robot, ROBOT"), (2, "an arm"), (3, None)])
    got = {(r["doc_id"], r["label"]): (r["total"], r["words"]) for r in A.label_totals(docs, rules).collect()}
    assert got == {(1, "ai"): (19, 2), (1, "parts"): (6, 1), (2, "parts"): (3, 1)}
    twice = {(r["doc_id"], r["label"]): r["total"] for r in A.label_totals(docs, rules, lone_words_twice=True).collect()}
    assert twice == {(1, "ai"): 19, (1, "parts"): 6}


def test_states(spark):
    a = A.Automaton.build([b"he", b"she", b"his", b"hers"])
    assert len(a.word) == 10 and a.longest == 4
    row, end, word = a.matches(np.frombuffer(b"ushers", np.uint8), np.array([0, 6]))
    assert sorted(zip(row.tolist(), end.tolist(), word.tolist(), strict=True)) == [(0, 4, 0), (0, 4, 1), (0, 6, 3)]


def test_one_pass(spark):
    plan = A.occurrences(table(spark, [(1, "a")]), words(spark, ["a", "b"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_apart():
    group, start, size = np.array([0, 0, 0, 0, 1, 1, 1]), np.array([0, 1, 2, 9, 0, 3, 4]), np.full(7, 2)
    assert A.apart(group, start, size).tolist() == [True, False, True, True, True, True, False]


def test_label_totals_are_made_where_texts_are_read(spark):
    """Hits by the hundred a text were held and sent by id, label and word; a task's memory grew with all of them."""
    rules = spark.createDataFrame([("a", "x", 1), ("b", "x", 2)], "word string, label string, weight int")
    out = A.label_totals(table(spark, [(k, "a b a") for k in range(9)]), rules)
    assert {tuple(r) for r in out.collect()} == {(k, "x", 4, 2) for k in range(9)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan and "hashpartitioning" not in plan


@pytest.mark.parametrize("entries", [1 << 24, 1 << 14])
@pytest.mark.parametrize("kind", ["int", "double", "decimal(12,3)"])
def test_label_totals_against_a_loop(spark, monkeypatch, entries, kind):
    monkeypatch.setattr(A, "ENTRIES", entries)
    monkeypatch.setattr(A, "READ", 300)
    rng = random.Random(5)
    names = ["a", "aa", "AB", "ab", "b a", "é", "日本", "", None, *("".join(rng.choice("abc é") for _ in range(rng.randrange(1, 5))) for _ in range(30))]
    rules = [(w, rng.choice(["x", "y", None]), rng.choice([-2, 0, 5, None])) for w in names for _ in range(2)]
    texts = [(i % 50 if i % 50 < 3 else i, "".join(rng.choice("aabbc é日本") for _ in range(rng.randrange(80)))) for i in range(60)] + [(None, "ab"), (None, "ab b a"), (90, None), (91, "")]
    held = {}
    for i, t in texts:
        for (_, w), (_, apart) in brute([(i, t)], [w for w, _, _ in rules]).items():
            held[i, w] = held.get((i, w), 0) + apart
    for twice in (False, True):
        want = {}
        for (i, w), n in held.items():
            for word, label, weight in rules:
                if word and word.lower() == w and (not twice or n > 1 or " " in w):
                    total, words = want.get((i, label), (None, set()))
                    want[i, label] = (total if weight is None else (total or 0) + min(n, 3) * weight, words | {w})
        got = A.label_totals(table(spark, texts), spark.createDataFrame(rules, "word string, label string, weight int").withColumn("weight", F.col("weight").cast(kind)), lone_words_twice=twice)
        assert dict(got.dtypes)["total"] == {"int": "bigint", "double": "double"}.get(kind, "decimal(38,3)")
        rows = got.collect()
        assert len(rows) == len(want) and {(r["doc_id"], r["label"]): (r["total"], r["words"]) for r in rows} == {k: (t, len(w)) for k, (t, w) in want.items()}


def test_label_totals_of_nothing(spark):
    rules = spark.createDataFrame([("a", "x", 1)], "word string, label string, weight int")
    assert A.label_totals(table(spark, [(1, "b"), (2, None)]), rules).count() == 0
    assert A.label_totals(table(spark, [(1, "a")]), rules.filter("false")).count() == 0
    big = spark.createDataFrame([("a", "x", 1 << 61)], "word string, label string, weight long")
    assert A.label_totals(table(spark, [(1, "a a a")]), big).first()["total"] == 3 << 61
