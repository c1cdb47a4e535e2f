"""Names before a letter beyond ASCII, against SQL, whose words end there."""

import duckdb

import __spark_entry__ as entry

START = "Er kam. " * 119  # 951 characters; a budget of 900 ends within them
TEXTS = [START + "Enachsch Erachü kam nicht. Da.", START + "Erachü kam.", "Über die ÜAbCd software. " * 40, START + "xüAbCd ging."]


def test_relevant_budget(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    df = entry.queries()["relevant_budget"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"SELECT doc_id, n FROM ({entry.oracle_sql()['relevant_budget']})").fetchall())


def test_names_end_at_other_letters(value):
    from pyspark.sql import functions as F

    from rosterlens.operators import profile as P

    text = START + "Enachsch Erachü kam nicht."
    assert value(lambda t: P.relevant_text(t, 200), text=text).startswith("Enachsch Erachü kam nicht. Er kam.") and value(lambda t: F.regexp_extract(t, P.BRAND, 0), text="x üAbCd") == "AbCd"
