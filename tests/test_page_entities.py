"""Entities that are cut off, as in a heading that ends with ``&amp``, against the queries' SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

PAGE = (
    "<html><body><article><h1>A heading of R&amp;D that is cut &amp</h1><p>A paragraph of the page &copy; with text that says &lt;so&gt;.</p></article>"
    '<div class="ad">An advertisement that is cut &amp</div><ul><li><a href="/a">An item that is cut &quot</a></li></ul></body></html>'
)


@pytest.mark.parametrize("name", ["main_text", "page_headings", "page_main_text", "section_text"])
def test_cut_entities_stay(spark, tmp_path, name):
    spark.createDataFrame([(1, "https://a.example", PAGE)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    df = entry.queries()[name](spark, str(tmp_path))
    expected = con.execute(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert [tuple(r) for r in df.collect()] == expected
