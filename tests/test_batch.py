"""The whole batch: roster file, pages or sandbox, cache, model with retries, files and report."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from rosterlens.plans import batch
from rosterlens.sources import readers

NOW = datetime(2026, 1, 2, 12)


def roster(tmp_path):
    path = str(tmp_path / "roster.csv")
    with open(path, "w") as f:
        f.write("Company,Website\nGray Fern,gray-fern.example\nBlue Moss,blue-moss.example\nGray Fern,https://www.gray-fern.example/home\nSmall,small.example\n")
    return path


def test_sandbox_batch_with_cache(spark, tmp_path):
    cache = str(tmp_path / "cache")
    got = batch.run(spark, roster(tmp_path), str(tmp_path / "out"), cache=cache, as_of=NOW, offline=True)
    report = got["report"].first()
    assert (report["total"], report["ranked"]) == (3, 3)
    rows = readers.load_results(spark, None, str(tmp_path / "out/ranked_csv")).collect()
    assert [r["company_name"] for r in rows] == ["Gray Fern", "Blue Moss", "Small"] and rows[0]["score"] > 35
    assert readers.results_from_json(spark.read.json(str(tmp_path / "out/ranked_json"))).count() == 3
    assert spark.read.parquet(cache).count() == 3
    # Fresh pages are taken from the cache; old ones are made anew.
    batch.run(spark, roster(tmp_path), str(tmp_path / "out"), cache=cache, as_of=NOW + timedelta(hours=24), offline=True)
    assert spark.read.parquet(cache).count() == 3
    batch.run(spark, roster(tmp_path), str(tmp_path / "out"), cache=cache, as_of=NOW + timedelta(hours=25), offline=True)
    assert spark.read.parquet(cache).count() == 6


def test_batch_over_pages(spark, tmp_path):
    words = "The robot uses lidar and slam for warehouse automation and object detection in every yard that we know of today. "
    html = "<html><body><main>" + "".join(f"<p>{i} {words}</p>" for i in range(12)) + "</main></body></html>"
    pages = spark.createDataFrame([("https://gray-fern.example", html), ("https://blue-moss.example", "<p>Only a few words are here, not enough.</p>")], "url string, html string")
    got = batch.run(spark, roster(tmp_path), str(tmp_path / "out"), pages=pages, as_of=NOW)
    report = got["report"].first()
    assert (report["total"], report["ranked"], report["too_short"], report["crawl_errors"]) == (3, 1, 1, 1)
    assert got["ranked"].first()["company_name"] == "Gray Fern"
    nothing = batch.run(spark, roster(tmp_path), str(tmp_path / "none"), pages=pages.filter("false"), as_of=NOW)
    assert nothing["report"].first()["ranked"] == 0 and not (tmp_path / "none/ranked_csv").exists()


def test_model_with_retry(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def load():
        def model(text):
            calls.add(1)
            if "Small" in text:
                raise TimeoutError
            if "Moss" in text and len(text) > 600:
                return ""
            return "```json\n" + json.dumps({"products": ["Navigator"], "technologies": ["SLAM"], "industry": "Robotics"}) + "\n```"

        return model

    got = batch.run(spark, roster(tmp_path), str(tmp_path / "out"), as_of=NOW, extractor=batch.model_extractor(load))
    rows = {r["name"]: r for r in spark.read.parquet(str(tmp_path / "out/outcomes")).collect()}
    assert [(rows[n]["call_ok"], rows[n]["call_retried"], rows[n]["extracted"]) for n in ("Gray Fern", "Blue Moss", "Small")] == [(True, False, True), (True, True, True), (False, True, False)]
    assert calls.value == 5, "each text is asked for once, and once more where that failed"
    m = got["calls"].first()
    assert (m["calls"], m["succeeded"], m["failed"], m["retried"]) == (3, 2, 1, 2)
    assert rows["Small"]["technologies"], "keywords stand in"
    assert got["ranked"].filter(F.col("score").isNull()).count() == 0
