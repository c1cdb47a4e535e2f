"""Caches by folder and by bucket, and reports gathered while outcomes are written."""

import json
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rosterlens.operators import vectors as V
from rosterlens.plans import batch
from rosterlens.sources import sinks

NOW = datetime(2026, 1, 2, 12)
SCHEMA = "website_key string, cached_at timestamp, value int"


def rows(spark, items):
    return spark.createDataFrame([(k, NOW + timedelta(hours=h), v) for k, h, v in items], SCHEMA)


def files(path):
    return {str(p.relative_to(path)) for p in path.rglob("*.parquet")}


def test_upserts_leave_other_files_alone(spark, tmp_path):
    path = tmp_path / "cache"
    sinks.upsert_cache(spark, str(path), rows(spark, [(f"k{i}", 0, i) for i in range(200)]), buckets=8)
    before = files(path)
    assert len({f.split("/")[1] for f in before}) == 8
    out = sinks.upsert_cache(spark, str(path), rows(spark, [("k3", 1, -3), ("k3", 2, -33), ("k5", -1, -5), ("new", 0, 7)]), buckets=64)
    got = {r["website_key"]: r["value"] for r in out.collect()}
    assert got == {**{f"k{i}": i for i in range(200)}, "k3": -33, "new": 7} and out.count() == 201
    after = files(path)
    touched = {f.split("/")[1] for f in before ^ after}
    assert 1 <= len(touched) <= 3 and {f for f in before if f.split("/")[1] not in touched} <= after, "files of untouched folders keep their names"
    assert sinks.upsert_cache(spark, str(path), rows(spark, [])).count() == 201 and files(path) == after
    assert sinks.upsert_cache(spark, str(tmp_path / "none"), rows(spark, [])).count() == 0


def test_fresh_rows_read_touched_folders(spark, tmp_path):
    path = str(tmp_path / "cache")
    new = rows(spark, [(f"k{i}", -i, i) for i in range(60)])
    sinks.upsert_cache(spark, path, new, buckets=16)
    keys = spark.createDataFrame([("k3",), ("k24",), ("k25",), ("other",)], "website_key string")
    got = sinks.fresh_rows(spark, path, new.schema, keys, F.lit(NOW))
    assert {r["website_key"] for r in got.collect()} == {"k3", "k24"}, "exactly a day old is fresh"
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert sinks.fresh_rows(spark, str(tmp_path / "none"), new.schema, keys, F.lit(NOW)) is None


def test_bucketed_vectors_are_not_shuffled(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i % 20}") for i in range(60)] + [(90, None), (91, " ")], "doc_id int, text string")
    none = spark.createDataFrame([], "key string, embedding array<double>")
    embed = lambda t: F.array(F.length(t).cast("double"))
    _, fresh = V.cached_embeddings(docs.filter("doc_id < 10"), none, embed=embed)
    sinks.write_embeddings_table(fresh, "test_vectors", str(tmp_path / "v"), buckets=8)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out, more = V.cached_embeddings(docs, spark.table("test_vectors"), embed=embed)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan, plan
        assert out.count() == 62 and more.count() == 11
        sinks.write_embeddings_table(more, "test_vectors", str(tmp_path / "v"), buckets=8)
        out, more = V.cached_embeddings(docs, spark.table("test_vectors"), embed=embed)
        assert more.count() == 0 and all(r["embedding"] == [float(len((r["text"] or "").strip()))] for r in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE IF EXISTS test_vectors")


def test_report_of_degraded_rows(spark, tmp_path):
    data = [(None, True, 0.9), (None, True, 0.2), (None, False, 0.9), (None, None, None), ("no_signal", False, 0.0), ("no_signal", True, 0.0), ("crawl_error", False, 0.0), ("too_short", None, None)]
    df = spark.createDataFrame(data, "skip_reason string, extracted boolean, confidence double").repartition(3)
    r = sinks.write_observed(df, str(tmp_path / "o")).first().asDict()
    assert r == {"total": 8, "ranked": 4, "crawl_errors": 1, "too_short": 1, "no_signal": 2, "full": 1, "llm_fallback": 3, "low_confidence": 1, "percent": 50.0}
    assert spark.read.parquet(str(tmp_path / "o")).count() == 8
    assert sinks.write_observed(df.filter("false"), str(tmp_path / "n")).first()["percent"] == 0.0


def test_a_model_that_hangs(spark, tmp_path):
    def load():
        def model(text):
            if "Moss" in text:
                time.sleep(60)
            return json.dumps({"products": ["Navigator"], "technologies": ["SLAM"], "industry": "Robotics"})

        return model

    path = tmp_path / "roster.csv"
    path.write_text("Company,Website\nGray Fern,gray-fern.example\nBlue Moss,blue-moss.example\n")
    began = time.monotonic()
    got = batch.run(spark, str(path), str(tmp_path / "out"), as_of=NOW, extractor=batch.model_extractor(load, seconds=0.5))
    assert time.monotonic() - began < 45
    report = got["report"].first()
    assert (report["total"], report["ranked"], report["llm_fallback"]) == (2, 2, 1)
    listed = json.loads((tmp_path / "out/ranked.json").read_text())
    assert [r["name"] for r in listed] == ["Gray Fern", "Blue Moss"]


def test_within():
    assert batch.within(None, lambda: "x") == batch.within(1, lambda: "x") == "x"
    with pytest.raises(TimeoutError):
        batch.within(0.05, lambda: time.sleep(5))
    with pytest.raises(ZeroDivisionError):
        batch.within(1, lambda: 1 / 0)


def test_health_gate(spark, tmp_path):
    got = batch.run(spark, str(tmp_path / "missing.csv"), str(tmp_path / "out"))
    assert set(got) == {"health"} and not got["health"].first()["file_exists"]
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    assert set(batch.run(spark, str(tmp_path / "bad.xlsx"), str(tmp_path / "out"))) == {"health"} and not (tmp_path / "out").exists()
