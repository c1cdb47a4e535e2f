"""Results that were written to several files are read back whole and in order."""

import os

import pytest
from pyspark.sql import functions as F

from rosterlens.sources import readers, sinks


@pytest.mark.parametrize("form", ["lines", "array", "csv"])
def test_several_files(spark, tmp_path, form):
    # Later names are longer, so the last file is the largest, which Spark reads first.
    rows = spark.range(200).select(
        F.col("id").alias("ord"), F.concat(F.lit("Firm "), "id", F.expr("repeat('x', int(id))")).alias("company_name"), F.concat("id", F.lit(".example")).alias("website"), (1000 - F.col("id")).cast("double").alias("score"),
        F.lit(0.5).alias("confidence"), F.array(F.struct(F.lit("A").alias("name"), F.lit("").alias("specifications"))).alias("products"), F.lit("{two}\n  {lines").alias("reason"),
    )
    key, path = "spark.sql.adaptive.coalescePartitions.enabled", str(tmp_path / form)
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        {"lines": sinks.write_json, "array": sinks.write_json_parts, "csv": sinks.write_csv}[form](rows, path)
    finally:
        spark.conf.set(key, old)
    assert sum(f.startswith("part-") for f in os.listdir(path)) > 2
    got = readers.load_results(spark, *((None, path) if form == "csv" else (path, None))).collect()
    assert [(r["position"], r["website"], r["reason"]) for r in got] == [(i + 1, f"{i}.example", "{two}\n  {lines") for i in range(200)]
