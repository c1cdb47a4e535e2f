"""Posting lists by parts: what is found is not shuffled, repeated names are indexed once, lots of queries and pieces of results are whole."""

import random

import pytest

from rosterlens.operators import postings as P


def test_places_are_not_shuffled(spark):
    """Above the index no row is sent anywhere; grouping by query, id and place sent one for each place of a run."""
    index = P.Postings.build(spark.createDataFrame([(i, f"Name {i}") for i in range(50)], "id long, name string"), "id", "name")
    plan = index.search(spark.createDataFrame([("name 1",)], "query string"))._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-*()0123456789")) for x in plan]
    scan = at = next(i for i, x in enumerate(plan) if "FileScan" in x)
    above = []
    for i in range(scan - 1, -1, -1):
        if plan[i].strip() and depth[i] < depth[at]:
            above.append(plan[i])
            at = i
    assert len(above) > 2 and not any("Exchange" in x for x in above), above


def test_repeated_names_are_indexed_once(spark):
    def places(times):
        names = spark.range(200 * times).selectExpr("id", "concat('Customer#', lpad(id % 200, 9, '0')) AS name")
        index = P.Postings.build(names, "id", "name")
        found = index.search(spark.createDataFrame([("MER#",), ("0017",)], "query string")).groupBy("query").count().collect()
        assert {r["query"]: r["count"] for r in found} == {"MER#": 200 * times, "0017": 11 * times}
        return spark.table(index.table).selectExpr("count(*) AS n", "sum(length(places)) AS size").first()

    assert places(1) == places(20)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_lots_and_pieces(spark, monkeypatch, kind):
    monkeypatch.setattr(P, "PART", 300)
    monkeypatch.setattr(P, "LOT", 5)
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abAé日😀 #") for _ in range(n))
    # Some ids have several names, some names several ids, some rows come twice.
    names = [(rng.randrange(70), text(rng.randrange(1, 14))) for _ in range(150)]
    names += names[:20] + [(i, "a name of all ab") for i in range(40)]
    queries = sorted({text(rng.randrange(1, 8)) for _ in range(60)} | {"A", "😀", "NAME OF ALL AB", "f all"})
    df = spark.createDataFrame(names, "id long, name string").selectExpr(f"cast(id AS {'bigint' if kind == 'long' else kind}) AS id", "name")
    got = [(r["query"], int(r["id"])) for r in P.Postings.build(df.repartition(3), "id", "name").search(spark.createDataFrame([(q,) for q in queries], "query string")).collect()]
    assert len(got) == len(set(got)) and set(got) == {(q, i) for q in queries for i, n in names if q.lower() in n.lower()}


def test_results_come_in_pieces(monkeypatch):
    """A batch holds about ``HELD`` ids, so a task's memory doesn't grow with what its queries find."""
    import pyarrow as pa

    monkeypatch.setattr(P, "HELD", 100)
    names = [b"customer %d" % i for i in range(60)]
    row = P._lists(pa.table({"part": pa.array([0] * 60, pa.int32()), "id": pa.array(range(60)), "low": pa.array(names)})).to_batches()[0].drop_columns(["part"])
    asked = [b"customer", b"1", b"mer ", b"x", b"tomer 5"]
    lots = {c: pa.array([v]) for c, v in (("queries", [q.decode() for q in asked]), ("lows", asked))}
    batches = list(P._found(iter([pa.record_batch({n: row[n] for n in row.schema.names} | lots)])))
    got = [(r["query"].encode(), i) for b in batches for r in b.to_pylist() for i in r["ids"]]
    assert len(batches) == 2 and sorted(got) == sorted((q, i) for q in asked for i, n in enumerate(names) if q in n)
