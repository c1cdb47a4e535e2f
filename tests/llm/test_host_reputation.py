"""The beta posterior's quantile against integration, and hosts with ports, users, dots and addresses."""

import math

import pytest
from pyspark.sql import functions as F

from rosterlens.llm import host_reputation as H


def integral(x, a, b, steps=20_000):
    """The regularised incomplete beta by Simpson's rule; for a < 1 after t = x * s**(1/a) takes away the pole at 0."""
    log_beta = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    if a < 1:
        f = lambda s: x**a / a * (1 - x * s ** (1 / a)) ** (b - 1) * math.exp(-log_beta)
    else:
        f = lambda s: x * (math.exp((a - 1) * math.log(x * s) + (b - 1) * math.log(1 - x * s) - log_beta) if s else math.exp(-log_beta) if a == 1 else 0.0)
    h = 1 / steps
    return (f(0) + f(1) + sum((4 if i % 2 else 2) * f(i * h) for i in range(1, steps))) * h / 3


CASES = [(2.0, 5.0), (0.3, 0.7), (7.3, 21.5), (0.05, 3.0), (150.0, 40.0), (4000.0, 5000.0), (30.0, 0.4), (1.0, 1.0)]


def test_quantile(spark):
    df = spark.createDataFrame(CASES, "a double, b double")
    got = df.select("a", "b", H.beta_quantile(0.05, F.col("a"), F.col("b")).alias("q")).collect()
    for r in got:
        step = 2e-9 if r["q"] < 1e-6 else 1e-6
        if r["q"] > 1e-8:
            assert integral(max(r["q"] - step, 1e-300), r["a"], r["b"]) <= 0.05 + 1e-5 and integral(r["q"] + step, r["a"], r["b"]) >= 0.05 - 1e-5, r
    assert next(r["q"] for r in got if r["a"] == r["b"] == 1.0) == pytest.approx(0.05, abs=1e-8)


def test_log_gamma(spark):
    xs = [1e-3, 0.3, 1.0, 2.5, 9.0, 1e3, 1e6]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [r["g"] for r in df.select(H.log_gamma(F.col("x")).alias("g")).collect()] == pytest.approx([math.lgamma(x) for x in xs], rel=1e-9, abs=1e-9)


def test_quantile_nears_the_normal_form(spark):
    mean, w = 0.3, H.NORMAL
    q = spark.range(1).select(H.beta_quantile(0.05, F.lit(mean * w), F.lit((1 - mean) * w)).alias("q")).first()["q"]
    assert q == pytest.approx(mean - H.Z * math.sqrt(mean * (1 - mean) / (w + 1)), abs=5e-5)


def test_sites(value):
    site = {"a.example.com:8080": "a.example.com", "user:pw@a.example.com": "a.example.com", "example.com.": "example.com", "example.com..:80": "example.com", "1.2.3.4:80": "1.2.3.4", "[::1]:80": "[::1]", "": ""}
    for host, want in site.items():
        assert value(H.site_of, h=host) == want
    for name, domain, suffix in (("a.b.example.com", "example.com", "com"), ("1.2.3.4", "1.2.3.4", ""), ("[::1]", "[::1]", ""), ("a.co.uk", "a.co.uk", "co.uk"), ("localhost", "localhost", ""), ("", "", "")):
        assert value(H.registered_domain, h=name) == domain and value(H.suffix_of, h=domain) == suffix


def test_reputation_is_the_sites(spark):
    hosts = ["bad.example.com", "bad.example.com:8080", "bad.example.com.", "u@bad.example.com", "10.0.0.1", "10.0.0.2:99"]
    pages = spark.createDataFrame([(i, f"http://{hosts[i % 6]}/p{i}") for i in range(240)], "page_id long, url string")
    marks = spark.createDataFrame([(i, i % 6 < 3) for i in range(240) if i % 6 in (0, 1, 2, 4)], "page_id long, bad boolean")
    rows = H.judge(pages, marks, ()).collect()
    by = {r["host"]: (r["verdict"], r["n_labelled"]) for r in rows}
    assert len(rows) == 240 and set(by) == set(hosts)
    assert {by[h] for h in hosts[:4]} == {("block", 120)} and by["10.0.0.1"] == ("allow", 40) and by["10.0.0.2:99"] == ("allow", 0)
