import math

from hypothesis import given, settings
from hypothesis import strategies as st

from rosterlens.functions import text as T
from rosterlens.functions import urls as U
from rosterlens.functions.arrays import distinct_ignoring_case
from rosterlens.operators import html as H


def test_clean_and_sentences(value):
    assert value(T.clean_text, t="Hello\n\nWorld   !!! ###") == "Hello World !!!"
    assert value(T.clean_text, t=None) == ""
    assert value(T.sentences, t="One. Two!\n\nThree? four") == ["One.", "Two!", "Three?", "four"]
    assert value(T.sentences, t="") == []


def test_summaries(value):
    long = "word " * 200
    assert len(value(T.summary, t=long)) <= 350
    s = "This sentence has well over forty characters in it. Short. Another sentence that is longer than forty chars, "
    assert value(T.summary, t=s) == "This sentence has well over forty characters in it. Another sentence that is longer than forty chars"
    assert value(T.two_sentence_summary, t="tiny") == "No meaningful content available."
    assert value(T.with_full_stop, t="Done") == "Done." and value(T.with_full_stop, t="Done!") == "Done!"
    assert value(T.short_summary, t="") == ""


def test_extraction_lines(value):
    t = "Alpha beta gamma. Alpha  beta gamma. " + " ".join(["w"] * 30) + ". One. Two. Three. Four."
    assert value(T.extraction_text, t=t).split("\n") == ["Alpha beta gamma", "One", "Two", "Three"]


def test_single_values(value):
    assert value(T.email, t="write to a.b@c.example.org now") == "a.b@c.example.org"
    assert value(T.phone, t="call +1 (555) 123-4567 or") == "+1 (555) 123-4567"
    assert value(T.phone, t="2022-2025 x") == "2022-2025"
    assert value(T.prices, t="$5 or $5 and ₹1,000.50") == "$5, ₹1,000.50"
    assert value(T.prices, t="none") is None
    assert value(T.price_bucket, t="Ask for a QUOTE") == "Quoted"
    assert value(T.address, t="x\n12 Main Street\n") == "12 Main Street"
    assert value(T.quality_flag, t="a" * 1000) == "GOOD" and value(T.quality_flag, t=None) == "FAILED"


def test_titles_and_specs(value):
    assert value(T.title_tokens, t="drone PLATFORM x2") == "Drone PLATFORM X2"
    assert len(value(T.spec_text, t="word " * 60)) <= 140
    assert value(T.clean_string, t="The thing") == "" and value(T.clean_string, t=" Robotics ") == "Robotics"


def test_dashboard_strings(value):
    assert value(T.product_parts, t="Alpha, beta AND gamma;delta").asDict() == {"name": "Alpha", "features": ["beta", "gamma", "delta"]}
    assert value(T.product_parts, t="  ") is None
    assert len(value(T.specification_parts, t=",".join(map(str, range(20))))) == 8
    assert value(T.specification_parts, t="1.5 kg. 3 m") == ["1.5 kg", "3 m"]
    assert len(value(T.technology_parts, t=" and ".join(map(str, range(20))))) == 12
    assert value(T.format_score, s="12.34") == "12.3%" and value(T.safe_score, s="abc") == 0.0


def test_urls(value):
    assert value(U.normalize, u=" example.com/a/?q=1#f ") == "https://example.com/a"
    assert value(U.normalize, u="") == "" and value(U.normalize, u=None) == ""
    assert value(U.domain, u="https://user@WWW.Example.com:80/x") == "example.com"
    assert value(U.roster_key, u="HTTP://www.acme.com/path") == "acme.com"
    assert value(U.cache_key, u="https://a.b/") == "https_a_b" and value(U.cache_key, u="//") == "unknown"
    assert value(U.should_skip, u="https://photos.example.com/x") is True
    assert value(U.should_skip, u="https://example.com/a.pdf") is True


def test_resolve_like_the_standard_library(spark):
    from urllib.parse import urljoin

    bases = ["http://a.example/b/c/d?q=1", "https://a.example", "http://a.example/x/"]
    hrefs = ["/k", "e", "../e", "./e", "?y", "#f", "//b.example/z", "https://c.example/q", "../../../g", "e/../f", "."]
    rows = [(b, h) for b in bases for h in hrefs]
    df = spark.createDataFrame(rows, "b string, h string")
    from pyspark.sql import functions as F

    got = [r["u"] for r in df.select(U.resolve(F.col("b"), F.col("h")).alias("u")).collect()]
    strip = lambda u: u.rstrip("/")
    assert [strip(g) for g in got] == [strip(urljoin(b, h)) for b, h in rows]


def test_links(value):
    html = '<a href="/products?x=1">P</a><a href="/solutions">S</a><a href="/privacy">no</a><a href="/blog">no</a><a href="https://other.example/products">no</a><a href="#x">no</a>'
    got = value(lambda h, b: H.scored_links(h, b), h=html, b="https://acme.com")
    assert [r["url"] for r in got] == ["https://acme.com/products", "https://acme.com/solutions"]
    assert value(lambda h, b: H.plain_links(h, b), h='<a href="/A">x</a><a href="/a">y</a>', b="https://acme.com") == ["https://acme.com/A"]


def test_visible_text(value):
    assert value(H.visible_text, h="<nav>x</nav><p>A &amp; B<br>c</p><script>var t='</p>'</script>") == "A & B c"
    assert value(H.visible_text, h=None) == ""


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from(["A", "a", "b", "B", "c", ""]), max_size=8))
def test_distinct_ignoring_case(spark, items):
    from pyspark.sql import functions as F

    seen, want = set(), []
    for x in items:
        if x.lower() not in seen:
            seen.add(x.lower())
            want.append(x)
    df = spark.createDataFrame([(items,)], "x array<string>")
    assert df.select(distinct_ignoring_case(F.col("x")).alias("v")).first()["v"] == want
    assert math.isfinite(len(want))
