"""Places of rows in a total order, however the input is split, and results that come back whole."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rosterlens.operators.rank import file_order, positions
from rosterlens.plans import service
from rosterlens.sources import folders, readers, sinks


def test_positions(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 1.0, 1.0, 1.0, 2.5, -3.0])) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(7)
    want = {k: p for p, (k, _) in enumerate(sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0])), 1)}
    assert {r["k"]: r["position"] for r in positions(df, [F.desc("v"), "k"]).collect()} == want
    assert {r["k"]: r["place"] for r in positions(df, [F.desc("v"), "k"], "place", 0).collect()} == {k: p - 1 for k, p in want.items()}
    assert positions(df.filter("false"), ["k"]).count() == 0


def test_positions_have_no_single_task(spark):
    df = spark.range(1000).withColumn("v", F.lit(1))
    parts = positions(df, ["v", "id"]).select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 1, "a value that all rows have is split by the columns behind it"


def test_file_order_does_not_hang_on_splits(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.range(0, 5000, 1, 5).select(F.concat(F.lit("line "), "id").alias("value")).write.text(path)
    want = None
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("200", "3000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = [r["value"] for r in positions(spark.read.text(path).select("value", file_order().alias("at")), ["at"]).orderBy("position").collect()]
            assert want in (None, got)
            want = got
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert want == [f"line {i}" for i in range(5000)]


def results(spark, n=40):
    rows = [(i, f"Firm {i}" if i % 7 else None, f"f{i}.example", float(i % 5), ["A, b", 'say "x"'], "two\nlines" if i % 2 else "") for i in range(n)]
    df = spark.createDataFrame(rows, "ord long, company_name string, website string, score double, products array<string>, reason string").repartition(5)
    return df.withColumns({"products": F.transform("products", lambda n: F.struct(n.alias("name"), F.lit("").alias("specifications"))), "confidence": F.lit(0.5)})


ORDER = [f"f{i}.example" for s in (4, 3, 2, 1, 0) for i in range(40) if i % 5 == s]


@pytest.mark.parametrize("form", ["lines", "parts", "array", "compact", "csv"])
def test_results_come_back_whole(spark, tmp_path, form):
    path = str(tmp_path / form)
    df = results(spark)
    if form == "compact":
        sinks.write_json_array(df, str(tmp_path / "indented"))
        (tmp_path / "compact").write_text(json.dumps(json.loads((tmp_path / "indented").read_text())))
    else:
        {"lines": sinks.write_json, "parts": sinks.write_json_parts, "array": sinks.write_json_array, "csv": sinks.write_csv}[form](df, path)
    for size in ("400", "128m"):
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = readers.load_results(spark, *((None, path) if form == "csv" else (path, None))).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert [r["website"] for r in got] == ORDER and [r["position"] for r in got] == list(range(1, 41))
        assert {r["reason"] for r in got} == {"two\nlines", ""}


def test_parts_are_the_file(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_csv(results(spark), str(tmp_path / "csv"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = sorted(p for p in (tmp_path / "csv").iterdir() if p.name.startswith("part-"))
    whole = b"".join(p.read_bytes() for p in files).decode()
    assert len(files) > 1 and whole.startswith("company_name,website,score,") and whole.count("company_name,") == 1
    sinks.write_json_parts(results(spark), str(tmp_path / "json"))
    whole = "".join(p.read_text() for p in sorted((tmp_path / "json").iterdir()) if p.name.startswith("part-"))
    assert [r["website"] for r in json.loads(whole)] == ORDER and whole.startswith("[\n  {")
    sinks.write_json_array(results(spark).filter("false"), str(tmp_path / "none"))
    assert json.loads((tmp_path / "none").read_text()) == []
    (tmp_path / "short").write_text(" []\n")
    for name in ("none", "short"):
        assert readers.load_results(spark, str(tmp_path / name), None).count() == 0


def test_broken_json_falls_back(spark, tmp_path):
    sinks.write_csv(results(spark, 3), str(tmp_path / "csv"))
    for name, text in {"cut": '{"name": "A", "score": 1}\n{"name": ', "empty": "", "words": "no json", "list": '[1, 2]', "lone": '"text"'}.items():
        (tmp_path / name).write_text(text)
        assert readers.load_results(spark, str(tmp_path / name), str(tmp_path / "csv")).count() == 3
    with pytest.raises(FileNotFoundError):
        readers.load_results(spark, str(tmp_path / "cut"), None)
    (tmp_path / "odd").write_text('{"company_name": " B ", "score": "7.256", "products": "x, y", "services": [" s ", ""], "breakdown": {"ai": 2}}\n{"score": null, "products": null}\n')
    a, b = readers.load_results(spark, str(tmp_path / "odd"), None).collect()
    assert (a["company_name"], a["score"], a["products"], a["services"], a["breakdown"]) == ("B", 7.26, ["x", "y"], ["s"], {"ai": 2.0})
    assert (b["company_name"], b["score"], b["products"], b["category"]) == ("Unknown", 0.0, [], "Low Potential")


def test_roster_keeps_its_file_order(spark, tmp_path):
    path = tmp_path / "roster.csv"
    path.write_text("Company,Website\n" + "".join(f"Firm {i % 90},f{i % 90}.example\n" for i in range(300)))
    got = readers.load_companies(spark, str(path)).orderBy("ord").collect()
    assert [(r["ord"], r["name"]) for r in got] == [(i, f"Firm {i}") for i in range(90)]


def test_dashboard_ids(spark):
    rows = spark.createDataFrame([("A", "a.io", "1"), (None, None, "9"), ("C", "http://c.io", "nan")], "company_name string, website string, score string")
    got = {r["id"]: (r["company_name"], r["website"]) for r in service.dashboard_rows(rows).collect()}
    assert got == {"company-site-0": ("Unknown", ""), "A-a.io-1": ("A", "https://a.io"), "C-http://c.io-2": ("C", "http://c.io")}


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "yarn"})

    with pytest.raises(ValueError):
        folders.work_folder(Session(), "x")
