"""Names by posting lists against plain containment."""

import random
import time

import pytest

from rosterlens.operators import postings as P


@pytest.mark.parametrize("part", [1 << 16, 7])
def test_search(spark, monkeypatch, part):
    monkeypatch.setattr(P, "PART", part)
    rng = random.Random(part)
    names = [(i, "".join(rng.choice("abAB é日ß#0") for _ in range(rng.randrange(12)))) for i in range(80)] + [(90, None), (91, ""), (None, "abc"), (3, "another abab name"), (92, "aaaaaaaaaa")]
    queries = ["a", "AB", "aba", "abab", "bababa", "日", "é#", "aaaaaaa", "", None, "zzz", "another abab name and more", "Another", *("".join(rng.choice("abé 0") for _ in range(rng.randrange(1, 6))) for _ in range(30))]
    index = P.Postings.build(spark.createDataFrame(names, "id long, name string").repartition(3), "id", "name")
    got = {(r["query"], r["id"]) for r in index.search(spark.createDataFrame([(q,) for q in queries], "query string")).collect()}
    assert got == {(q, i) for q in queries if q for i, n in names if i is not None and n and q.lower() in n.lower()}
    assert index.search(spark.createDataFrame([], "query string")).count() == 0
    assert P.Postings.build(spark.createDataFrame([], "id long, name string"), "id", "name").search(spark.createDataFrame([("a",)], "query string")).count() == 0


def test_lists_are_not_shuffled(spark):
    index = P.Postings.build(spark.createDataFrame([(i, f"Name {i}") for i in range(50)], "id long, name string"), "id", "name")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = index.search(spark.createDataFrame([("name 1",)], "query string"))
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    lines = plan.split("\n")
    scan = next(i for i, x in enumerate(lines) if "FileScan" in x)
    indent = len(lines[scan]) - len(lines[scan].lstrip(" :+-*()0123456789"))
    above = []
    for x in reversed(lines[:scan]):
        own = len(x) - len(x.lstrip(" :+-*()0123456789"))
        if own < indent:
            above.append(x)
            indent = own
        if "SortMergeJoin" in x and own <= indent:
            break
    assert sum("FileScan" in x for x in lines) == 1 and "Bucketed: true" in lines[scan]
    assert above and not any("Exchange" in x for x in above), above


def test_long_lists_meet_in_proportion(spark):
    """Every name holds the query's runs at many places: lists of 200,000 places, which pairwise comparison takes minutes for."""
    n = 20_000
    names = spark.range(n).selectExpr("id", "concat('Customer#', lpad(id, 3, '0'), '000000000000') AS name")
    index = P.Postings.build(names, "id", "name")
    t = time.perf_counter()
    got = index.search(spark.createDataFrame([("MER#0",), ("00000000",)], "query string")).groupBy("query").count().collect()
    assert {r["query"]: r["count"] for r in got} == {"MER#0": 100, "00000000": n} and time.perf_counter() - t < 40
