"""Texts are lowered once, cut up only where they hold a word, and no further than results need."""

import re

import pytest
from pyspark.sql import functions as F

from rosterlens.functions import arrays as A
from rosterlens.functions import text as T
from rosterlens.operators import lexicon as X
from rosterlens.operators import vectors as V


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(1, "Our Robot platform. It maps."), (2, "   "), (3, None), (4, "bank loans and APIs at a bank")], "doc_id int, text string")


def test_a_list_of_words_lowers_a_text_once(texts):
    low = F.lower("text")
    assert plan(texts.select(A.contains_any(low, ("a", "b", "c")).alias("x"))).count("lower(") == 1
    assert not re.search(r"lambda[^(]*\(contains\(lower", plan(texts.select(X.words_present(low, ("a", "b", "c")).alias("x"))))


def test_what_stands_behind_is_not_looked_at(spark):
    bad = lambda s: F.when(s == "bad", F.raise_error(F.lit("looked at"))).otherwise(F.length(s) > 1)
    items = F.split(F.lit("aa,b,cc,bad"), ",")
    row = spark.range(1).select(A.first_fit(items, bad, 2).alias("a"), A.first_distinct(items, F.lower, bad, 2).alias("b")).first()
    assert row["a"] == row["b"] == ["aa", "cc"]
    assert spark.range(1).select(A.first_distinct(F.split(F.lit("Aa,b,aA,cc"), ","), F.lower, lambda s: F.length(s) > 1, 5)).first()[0] == ["Aa", "cc"]


def test_texts_without_a_word_are_not_cut_up(spark):
    parts = F.when(F.col("low") == "plain", F.raise_error(F.lit("cut up")).cast("array<string>")).otherwise(F.split("low", " "))
    got = spark.createDataFrame([("plain",), ("a word here",)], "low string").select(T.holding(parts, F.col("low"), ("word", "other"))).collect()
    assert sorted(r[0] for r in got) == [[], ["word"]]


def test_stripping_is_that_of_the_pattern(spark):
    spaces = [chr(i) for i in range(0x3100) if chr(i) not in "᠎"]
    df = spark.createDataFrame([(f"{c}a{c} b{c}{c}",) for c in spaces] + [("",), (None,), (" \t",)], "t string")
    want = F.regexp_replace("t", r"(?U)^\s+|\s+\z", "")
    assert df.filter(~T.strip(F.col("t")).eqNullSafe(want)).count() == 0
    want = F.regexp_replace("t", r"^[ ,.;:\-]+|[ ,.;:\-]+\z", "")
    assert df.filter(~T.strip_chars(F.col("t"), " ,.;:-").eqNullSafe(want)).count() == 0


def test_replacing_is_in_turn(value):
    assert value(lambda t: A.replace_each(t, (("a", "b"), ("b", "c"))), t="ab-a") == "cc-c"
    assert value(lambda t: A.replace_each(t, (("a", "b"),)), t=None) is None


def test_descriptions_are_embedded_once(spark, texts):
    assert "bank accounts" not in plan(V.classify(texts))
    got = {r["doc_id"]: (r["industry"], r["confidence"]) for r in V.classify(texts).collect()}
    assert got[2] == got[3] == ("Other", 0.0) and got[4][0] == "Finance"
    vector = spark.range(1).select(V.hash_vector(F.lit("a b A"), 8)).first()[0]
    assert len(vector) == 8 and sum(vector) == 3.0 and max(vector) >= 2.0


def test_words_are_found_by_gates(spark):
    words = ["machine learning", "deep learning", "learning kit", "drone", " ros ", "ros2", "ml"]
    groups = X.gates(words)
    assert sorted(w for _, own in groups for w in own) == sorted(words) and len(groups) < len(words)
    assert all(gate in w for gate, own in groups for w in own)
    df = spark.createDataFrame([("a learning drone",), ("deep learning kit ros ros2",), ("html",), ("",), (None,)], "low string")
    got = [sorted(r["w"] or []) for r in df.select(X.held_words(F.col("low"), words).alias("w")).collect()]
    assert got == [sorted(w for w in words if w in (r["low"] or "")) for r in df.collect()]
