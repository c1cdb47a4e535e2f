"""Crawls by a recursive query against a queue in Python; company data from keywords and from replies."""

import json
import random
from collections import deque

from pyspark.sql import functions as F

from rosterlens.operators import crawl as C
from rosterlens.plans.extraction import company_data, page_sections, replied_pages


def graph(seed, sites=4, size=14):
    rng = random.Random(seed)
    pages = {}
    for s in range(sites):
        for k in range(size):
            links = [f"/p{rng.randrange(size + 2)}" if rng.random() < 0.8 else rng.choice(["/other", "https://elsewhere.example/p1", "#x", f"https://s{s}.example", f"p{rng.randrange(size)}"]) for _ in range(rng.randrange(6))]
            pages[f"https://s{s}.example" if k == 0 else f"https://s{s}.example/p{k}"] = links
    return pages


def queue(pages, root, max_depth, max_pages):
    out, seen, todo = [], {root}, deque([(root, 0)])
    while todo and len(out) < max_pages:
        url, depth = todo.popleft()
        if url not in pages:
            continue
        out.append((url, depth))
        if depth == max_depth:
            continue
        for link in dict.fromkeys(pages[url]):
            site = root
            full = link if link.startswith("https") else f"{site}{link}" if link.startswith("/") else url if link.startswith("#") else f"{site}/{link}"
            full = full.rstrip("/")
            if full.startswith(site + "/") and "/p" in full and full not in seen:
                seen.add(full)
                todo.append((full, depth + 1))
    return out


def test_crawl_depth(spark):
    for seed in range(3):
        pages = graph(seed)
        html = spark.createDataFrame([(u, " ".join(f'<a href="{x}">{i}</a>' for i, x in enumerate(links)) + f"<!-- {u} -->") for u, links in pages.items()], "url string, html string").repartition(3)
        roots = spark.createDataFrame([(f"https://s{s}.example",) for s in range(4)] + [("https://none.example",), ("",)], "website string")
        for depth, most in ((2, 8), (3, 100), (0, 8)):
            got = {}
            for r in C.crawl_depth(roots, html, depth, most, keywords=("/p",)).orderBy("website", "at").collect():
                got.setdefault(r["website"], []).append((r["url"], r["depth"]))
            assert got == {f"https://s{s}.example": queue(pages, f"https://s{s}.example", depth, most) for s in range(4)}


def test_limits_of_recursion_are_put_back(spark):
    before = spark.conf.get("spark.sql.cteRecursionLevelLimit")
    C.crawl_depth(spark.createDataFrame([("https://a.example",)], "website string"), spark.createDataFrame([("https://a.example", "")], "url string, html string"))
    assert spark.conf.get("spark.sql.cteRecursionLevelLimit") == before and not [t for t in spark.catalog.listTables() if t.name.startswith(("links_", "starts_"))]


PAGES = [
    ("https://a.example", '<a href="/products">x</a><p>Our product is the Dock Mapper platform. Nothing else.</p>'),
    ("https://a.example/products", "<p>Our product SkyLoom runs LiDAR and SLAM for warehouse robot fleets, a warehouse automation service. Products: SkyLoom.</p>"),
    ("https://b.example", "<p>We say nothing of use.</p>"),
]


def sites(spark):
    return spark.createDataFrame([("https://a.example",), ("https://b.example",), ("https://c.example",)], "website string"), spark.createDataFrame(PAGES, "url string, html string")


def test_company_data_from_keywords(spark):
    roots, pages = sites(spark)
    got = {r["website"]: r for r in company_data(roots, pages).collect()}
    a = got["https://a.example"]
    assert "SkyLoom" in a["products"] and {"LiDAR", "SLAM"} <= set(a["technologies"]) and a["confidence"] == 1.0
    assert [got[f"https://{c}.example"]["confidence"] for c in "bc"] == [0.0, 0.0] and got["https://c.example"]["products"] == []


def test_company_data_from_replies(spark):
    roots, pages = sites(spark)
    replies = {"Dock": {"products": ["Dock Mapper", "dock mapper"], "industry": ""}, "SkyLoom": {"products": ["SkyLoom", "DOCK MAPPER"], "technologies": ["SLAM"], "industry": ["Robotics"]}}

    def extractor(df):
        reply = F.when(F.col("text").contains("SkyLoom"), json.dumps(replies["SkyLoom"])).when(F.col("text").contains("Dock"), json.dumps(replies["Dock"])).otherwise("no answer")
        return df.withColumn("reply", reply)

    got = {r["website"]: r for r in company_data(roots, pages, replied_pages(extractor)).collect()}
    a = got["https://a.example"]
    assert (a["products"], a["technologies"], a["industry"], a["confidence"]) == (["Dock Mapper", "SkyLoom"], ["SLAM"], "Robotics", 1.0)
    assert got["https://b.example"]["confidence"] == 0.0


def test_sections(spark):
    rows = spark.createDataFrame([("<p>A product here. Plain text. A PRODUCT here. Our service too!</p><script>product</script>",), (None,)], "html string")
    assert [r["text"] for r in page_sections(rows).collect()] == ["A product here.\nOur service too!", ""]
