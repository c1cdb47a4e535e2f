"""The tag table against trees of the standard library's parser."""

import random

import page_tree as M
import pytest

from rosterlens.operators import html as H
from rosterlens.operators import tags as G

PAGE = (
    '<html><head><meta name="description" content="About us"></head><body><nav>menu menu menu menu menu</nav>'
    "<main><h1>A heading of some size</h1><div><p>A paragraph with enough text in it.</p></div></main>"
    "<table><tr><td>Weight and size</td><td>12 kg</td></tr></table><div class='product-list'>Products are listed here</div></body></html>"
)
ODD = [
    None, "", "plain text & more &lt;b&gt;", "<p>" * 300 + "deep text of twenty characters and more", "a < b and <3 hearts", "<!-- <p>no</p> --><p>yes, this is a paragraph of text</p>", "<script>var t='</p><p>';</script><p>after the script there is text</p>",
    '<div class="service-list product" id="services">A service section of some length</div><ul><li>An item that is long enough</li><li>short</li></ul>', "<p>unclosed one with some words<p>unclosed two with some words</div>", "</p></b>stray ends", '<img src="x"/><br/>text <a href=\'u\'>anchor</a>',
    '<table><tr><th>Name of it</th><td>Value of it</td></tr></table><ol><li>An item of an ordered list</li></ol>' * 12, '<META NAME="description" CONTENT=" Mixed &amp; case "><H2>An upper case heading here</H2>', "<section>" + "<span>x</span>" * 9 + "and a text that is long enough for it</section>",
    '<footer><p>a footer text that is long enough here</p></footer><iframe><p>frame text that is long enough here</p></iframe>', "<div data-x='a>b' class=product>attribute with a bracket inside</div>", "<p>é日本 text ﬀ with other letters – and dashes</p>", "<!-- never closed <p>text</p>",
]


def made_up(n):
    rng = random.Random(7)
    tags = ["p", "div", "span", "li", "ul", "table", "tr", "td", "th", "h1", "h2", "nav", "footer", "section", "article", "b", "a", "br", "main"]
    words = ["product", "words &amp; signs", "About services of the house", "a", "Some longer piece of text here. ", "cookie policy", "\n "]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(50)):
            t = rng.choice(tags)
            attrs = rng.choice(["", "", ' class="product-x"', " id='service'", ' class="solution offering" id=q'])
            parts.append(rng.choice([f"<{t}{attrs}>", f"</{t}>", rng.choice(words), rng.choice(words)]))
        out.append("".join(parts))
    return out


def model(page):
    root = M.tree(page or "")
    return (M.main_text(page or ""), M.section_text(root, ("product", "solution")), M.section_text(root, ("service", "offering")), M.listed(root), M.heading_text(page or ""))


def test_parts(spark):
    pages = [PAGE, *ODD, *made_up(150)]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string").repartition(4)
    got = {r["page_id"]: tuple(r["parts"]) for r in H.page_parts(df).collect()}
    bad = [(i, got[i], model(p)) for i, p in enumerate(pages) if got[i] != model(p)]
    assert not bad, bad[0]
    assert got[0][0].startswith("About us A heading of some size") and got[0][1] == "Products are listed here" and got[0][3] == "Weight and size | 12 kg"


def test_rows_are_intervals(spark):
    df = spark.createDataFrame(list(enumerate(made_up(60))), "page_id int, html string")
    rows = G.tag_rows(df).collect()
    by = {}
    for r in rows:
        by.setdefault(r["page_id"], []).append(r)
    for nodes in by.values():
        nodes.sort(key=lambda r: r["pre"])
        assert [r["pre"] for r in nodes] == list(range(len(nodes)))
        for a in nodes:
            below = [b for b in nodes if a["pre"] < b["pre"] <= a["last"]]
            assert all(b["depth"] > a["depth"] and a["start"] <= b["start"] <= b["end"] <= a["end"] for b in below)
            assert sum(b["depth"] == a["depth"] + 1 for b in below) == a["children"]


def test_one_scan(spark):
    plan = H.page_parts(spark.createDataFrame([(1, PAGE)], "page_id int, html string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("page", [PAGE, "<p>" * 20_000, "<" * 20_000, "<a b='" * 5_000, "&amp;" * 20_000])
def test_scan_takes_no_long(page):
    import time

    t = time.perf_counter()
    G.scan(page)
    assert time.perf_counter() - t < 5


def test_elements_of_few_pages_are_held():
    """Of a batch of many pages, elements are Python objects for a few at a time."""
    import tracemalloc

    import pyarrow as pa

    pages = pa.array(["<p class='a'>text</p>" * 500] * 100 + [None])
    tracemalloc.start()
    try:
        got = G.tag_array(pages)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(got) == 101 and len(got[0]["nodes"]) == 500 and len(got[100]["nodes"]) == 0 and peak < 24 << 20, peak
