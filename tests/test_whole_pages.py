"""The main text of long pages is whole, in the query as in its SQL."""

import duckdb

import __spark_entry__ as entry


def test_long_page_is_whole(spark, tmp_path):
    body = "".join(f"<p>Paragraph {i} of a page that is longer than most, &lt;é&gt;.</p>" for i in range(400))
    pages = [(1, "https://a.example", f"<html><body><article><h1>A heading of some size</h1>{body}<p>These are the last words of it.</p></article></body></html>"), (2, "https://a.example/b", "<article><p>A page with one short paragraph.</p></article>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = [tuple(r) for r in entry.queries()["page_main_text"](spark, str(tmp_path)).orderBy("page_id").collect()]
    assert len(got[0][1]) > 20_000 and got[0][1].startswith("A heading of some size Paragraph 0 of") and got[0][1].endswith("These are the last words of it.")
    assert got == con.execute(f"SELECT page_id, main FROM ({entry.oracle_sql()['page_main_text']}) ORDER BY page_id").fetchall()
