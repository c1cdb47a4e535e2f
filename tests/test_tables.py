import io
import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rosterlens.operators import crawl as C
from rosterlens.operators import lexicon as X
from rosterlens.operators import roster as O
from rosterlens.operators import vectors as V
from rosterlens.plans import service
from rosterlens.sources import readers, sinks


def test_roster(spark):
    sheet = spark.createDataFrame([("Acme", "https://www.acme.com"), ("ACME", "http://acme.com/path"), (None, "x"), (" Beta ", " b.io "), ("", "c")], "`Company Name` string, Website string")
    got = O.clean_roster(sheet.coalesce(1)).orderBy("ord").collect()
    assert [(r["name"], r["website"]) for r in got] == [("Acme", "https://www.acme.com"), ("Beta", "b.io")]
    with pytest.raises(ValueError):
        O.clean_roster(spark.createDataFrame([("a",)], "x string"))
    assert O.company_column(["Company Name", "Company"]) == "Company"


def test_merge_matches_a_loop(spark):
    pages = spark.createDataFrame([("s", i, f"Sentence number {i} has more than forty characters here. Same sentence over forty characters each time.") for i in range(80)], "g string, o long, t string")
    got = O.merge_texts(pages, "g", "o", "t", most=300).first()["merged"]
    kept, seen = [], set()
    for i in range(80):
        for s in (f"Sentence number {i} has more than forty characters here.", "Same sentence over forty characters each time."):
            if s not in seen and len(" ".join(kept)) < 300:
                seen.add(s)
                kept.append(s)
    assert got == " ".join(kept)[:300]


def test_rule_tables_both_ways(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Alpha beta"), (2, "gamma ab"), (3, None), (4, "ab")], "doc_id long, text string")
    rules = spark.createDataFrame([("alpha",), ("ab",), ("gamma",), ("zz",), ("",)], "word string")
    want = {(1, "alpha"), (2, "gamma"), (2, "ab"), (4, "ab")}
    assert {(r["doc_id"], r["word"]) for r in X.match_rules(docs, rules).collect()} == want
    monkeypatch.setattr(X, "COMPILED", 1)
    assert {(r["doc_id"], r["word"]) for r in X.match_rules(docs, rules).collect()} == want


def test_crawl(spark):
    link = lambda *paths: "".join(f'<a href="{p}">product</a>' for p in paths)
    pages = spark.createDataFrame([
        ("https://a.example", link("/p1", "/p2", "/gone")), ("https://a.example/p1", link("/p3", "/p4", "/p5", "/p6", "/p7")), ("https://a.example/p2", link("/never")),
        ("https://a.example/p3", ""), ("https://a.example/never", ""), ("https://a.example/p7", ""),
    ], "url string, html string")
    roster = spark.createDataFrame([("a.example",)], "website string")
    got = [r["url"].rsplit("/", 1)[1] for r in C.crawl(roster, pages).orderBy("at").collect()]
    assert got == ["a.example", "p1", "p2", "p3"]  # eight places, of which some are missing pages
    deep = C.crawl_depth(roster, pages, keywords=("p",)).collect()
    assert {(r["depth"], r["url"].rsplit("/", 1)[1]) for r in deep} == {(0, "a.example"), (1, "p1"), (1, "p2"), (2, "p3"), (2, "p7"), (2, "never")}
    made = C.sandbox_pages(spark.createDataFrame([("https://acme-labs.example",)], "website string")).first()
    assert made["products"].startswith("Acme Labs Navigator") and made["quality"] == "GOOD"


def test_page_map(spark):
    rows = spark.createDataFrame([("a", 1, "u", "<p>The second page has this sentence.</p>"), ("a", 0, "v", "<p>The first page has this sentence.</p>")], "website string, at int, url string, html string")
    got = C.page_map(rows).first()
    assert got["all"] == "The first page has this sentence. The second page has this sentence." and got["quality"] == "FAILED"


def test_vectors(spark, value):
    assert value(lambda t: F.aggregate(V.hash_vector(t), F.lit(0.0), lambda a, x: a + x), t="a b a") == 3.0
    assert value(lambda t: F.size(V.hash_vector(t)), t="") == 256
    arr = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    assert value(lambda _: V.cosine(arr(1, 0), arr(1, 1)), x=1) > value(lambda _: V.cosine(arr(1, 0), arr(0, 1)), x=1) == 0.0
    docs = spark.createDataFrame([(1, "bank payments and lending"), (2, " ")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in V.classify(docs).collect()}
    assert got[1]["industry"] == "Finance" and got[2]["industry"] == "Other" and got[2]["confidence"] == 0.0
    assert {r["semantic_score"] for r in V.semantic_scores(docs, " ").collect()} == {0.0}
    cache = spark.createDataFrame([], "key string, embedding array<double>")
    full, fresh = V.cached_embeddings(docs, cache)
    assert fresh.count() == 2 and V.cached_embeddings(docs, fresh)[1].count() == 0 and full.count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, "A", "a.io", 73.912345, 0.5, ["X", "Y"], ["s"], None)], "ord long, company_name string, website string, score double, confidence double, products array<string>, services array<string>, price_range string")
    out = df.withColumn("products", sinks.products_json(F.col("products")))
    for c in ("technologies", "use_cases", "recommended_products"):
        out = out.withColumn(c, F.array().cast("array<string>"))
    sinks.write_csv(out, str(tmp_path / "csv"))
    back = readers.results_from_csv(readers.read_csv(spark, str(tmp_path / "csv"))).first()
    assert back["score"] == 73.91 and back["price_range"] == "" and json.loads(back["products"]) == [{"name": "X", "specifications": ""}, {"name": "Y", "specifications": ""}]
    sinks.write_json_array(out, str(tmp_path / "r.json"))
    rows = json.loads((tmp_path / "r.json").read_text())
    assert len(rows[0]) == 18 and rows[0]["name"] == "A" and rows[0]["price_range"] is None and rows[0]["products"] == ["X", "Y"]
    assert readers.load_results(spark, str(tmp_path / "r.json"), None).first()["company_name"] == "A"
    assert readers.load_results(spark, str(tmp_path / "missing"), str(tmp_path / "csv")).first()["website"] == "a.io"
    with pytest.raises(ValueError):
        readers.results_from_csv(spark.createDataFrame([("a",)], "x string"))


def test_products_text(value):
    assert [x["name"] for x in value(sinks.parse_products, v="A, B,,")] == ["A", "B"]
    assert [x["name"] for x in value(sinks.parse_products, v='[{"name": "A"}, {"name": " "}]')] == ["A"]
    assert value(sinks.parse_products, v=None) == []


def test_xlsx(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rows = [("Company", "Website"), ("Acme", "acme.com"), ("Beta", "b.io")]
    xml = "".join(f'<row r="{i + 1}">' + "".join(f'<c r="{"AB"[j]}{i + 1}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{xml}</sheetData></worksheet>")
    path = tmp_path / "r.xlsx"
    path.write_bytes(buffer.getvalue())
    assert [r["name"] for r in readers.load_companies(spark, str(path)).orderBy("ord").collect()] == ["Acme", "Beta"]
    row = readers.health(spark, str(path)).first()
    assert row["file_exists"] and row["file_readable"] and row["row_count"] == 2
    assert readers.health(spark, str(tmp_path / "no.xlsx")).first()["file_exists"] is False


def test_cache(spark, tmp_path):
    rows = lambda at, v: spark.createDataFrame([("k", at, v)], "website_key string, cached_at timestamp, data string")
    sinks.upsert_cache(spark, str(tmp_path / "c"), rows(datetime(2024, 1, 1), "old"))
    got = sinks.upsert_cache(spark, str(tmp_path / "c"), rows(datetime(2024, 1, 2), "new"))
    assert [r["data"] for r in got.collect()] == ["new"]
    now = F.lit(datetime(2024, 1, 3))
    assert O.fresh(got, now).count() == 1 and O.fresh(got, now, hours=23).count() == 0
    assert got.select(readers.stale(F.col("cached_at"), now).alias("s")).first()["s"] is True


def test_service(spark):
    started = []
    rows = spark.createDataFrame([(0, "Acme", "acme.com", 50.0)], "ord long, company_name string, website string, score double")
    s = service.Service(load=lambda: rows, start=lambda: started.append(1))
    now = datetime(2024, 1, 1, 12)
    assert s.companies(None, now)[0] == 202 and s.running and len(started) == 1
    assert s.companies(datetime(2024, 1, 1, 1), now)[0] == 200 and len(started) == 1  # one run at a time
    s.finished()
    assert s.companies(datetime(2024, 1, 1, 1), now)[0] == 200 and len(started) == 2 and s.status()["running"]
    assert service.named_like(rows, "ACM").count() == 1 and service.named_like(rows, " ").count() == 1
    assert service.summary(rows.limit(0)).first()["mean_score"] == 0.0
    assert service.dashboard_rows(rows).first()["website"] == "https://acme.com"


def test_streams(spark, tmp_path):
    from rosterlens.streaming import refresh

    spark.createDataFrame([(1, "autonomous drone"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    q = refresh.scored_stream(stream).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r["doc_id"]: r["score"] > 0 for r in spark.sql("select * from scored").collect()} == {1: True, 2: False}
    spark.createDataFrame([("k", datetime(2024, 1, 1), "v")], "website_key string, cached_at timestamp, data string").write.parquet(str(tmp_path / "c_in"))
    rows = spark.readStream.schema("website_key string, cached_at timestamp, data string").parquet(str(tmp_path / "c_in"))
    refresh.cache_writer(rows, str(tmp_path / "cache"), str(tmp_path / "ck")).start().awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 1


def test_grounded_items_are_whole(spark, tmp_path):
    from rosterlens.plans import catalogue

    item = "The opening of an item that is longer than forty characters, and its end"
    texts = [f"It says: {item.upper()}.", f"It says: {item[:60]}", item[:40], None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, item), (8, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [tuple(r) for r in catalogue.grounded_items(spark, str(tmp_path)).collect()] == [(0, 7)]
