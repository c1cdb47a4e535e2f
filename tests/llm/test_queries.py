import os

import pytest

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.mark.parametrize("name", ["op1_decontamination", "op5_host_reputation", "op6_suffix_dedup", "op7_jaccard_join", "op11_collocations", "op12_vector_codes"])
def test_sql(spark, name):
    import duckdb

    from rosterlens.llm import queries

    df = queries.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(tuple(map(str, (r[c] for c in cols))) for r in df.collect())
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    cur = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert got == sorted(tuple(str(r[names.index(c)]) for c in cols) for r in cur.fetchall())


def test_names():
    from rosterlens.llm import queries

    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, FOLDER)
    rows = out.collect()
    assert 0 < len(rows) < 200 and all(r["lossless"] for r in rows) and len({r["doc_id"] for r in rows}) == len(rows)


def test_clear(spark):
    from rosterlens.llm import jaccard_join, shared

    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string")
    assert {r["component_id"] for r in jaccard_join.classes(docs).collect()} == {1}
    assert any(t.name.startswith("rosterlens_") for t in spark.catalog.listTables())
    shared.clear(spark)
    assert not any(t.name.startswith("rosterlens_") for t in spark.catalog.listTables())
    assert {r["component_id"] for r in jaccard_join.classes(docs).collect()} == {1}
