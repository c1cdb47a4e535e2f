from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rosterlens.functions import lexicons as L
from rosterlens.operators import lexicon as X
from rosterlens.operators import profile as P
from rosterlens.operators import records as R
from rosterlens.operators import score as S
from rosterlens.plans import ranking


def test_golden_totals(value):
    """Shares, penalty and category of known results."""
    rows = [((35.0, 8.5, 10.4, 20.0), 0, 73.9, "Good Potential"), ((35.0, 0.0, 10.4, 20.0), 5, 60.4, "Good Potential"), ((26.6, 2.0, 6.0, 20.0), 0, 54.6, "Moderate"), ((29.4, 0.0, 10.4, 0.0), 5, 34.8, "Low Potential"), ((3.5, 2.0, 1.6, 0.0), 0, 7.1, "Low Potential")]
    for shares, pen, want, name in rows:
        parts = {k: F.lit(Decimal(str(v))).cast("decimal(8,2)") for k, v in zip(S.SHARES, shares, strict=True)}
        got = S.adjusted(S.total(parts), S.decimal("1.00"), F.lit(pen))
        assert value(lambda _: got.cast("double"), x=1) == want  # noqa: B023
        assert value(lambda _: S.category(got), x=1) == name  # noqa: B023
    fallback = S.adjusted(S.decimal("12.10"), S.decimal("0.60"), F.lit(10))
    assert value(lambda _: fallback.cast("double"), x=1) == 0.0


def test_factors_match_substrings(value):
    got = value(lambda t: F.struct(*(c.alias(k) for k, c in S.factors(t).items())), t="Autonomous navigation of a drone by email").asDict()
    assert got == {"domain": 84, "product": 25, "ai": 8, "use_case": 100}  # "email" holds "ai"
    assert value(S.score_text, t="") == 0.0


def test_multiplier_and_penalty(value):
    m = lambda q, e: value(lambda x: S.multiplier(F.lit(q), F.lit(e)), x=1)
    assert (m("GOOD", True), m("LOW", True), m("LOW", False), m("FAILED", False)) == (Decimal("1.00"), Decimal("0.70"), Decimal("0.42"), Decimal("0.30"))
    p = lambda q, e, c: value(lambda x: S.penalty(F.lit(q), F.lit(e), F.lit(c)), x=1)
    assert (p("GOOD", False, 0.9), p("LOW", True, 0.9), p("GOOD", True, 0.44), p("GOOD", True, 0.45)) == (10, 5, 5, 0)


def test_labels(value):
    rules = (("ab", "one", 5), ("cd", "two", 5), ("ef gh", "two", 1))
    assert value(lambda t: X.best_label(t, rules), t="cd ab") == "one"  # a tie goes to the earlier rule
    assert value(lambda t: X.best_label(t, rules), t="zz") == ""
    assert value(lambda t: X.top_labels(t, rules, 4, lone_words_twice=True), t="ab cd cd ef gh") == ["two"]
    assert value(lambda t: X.occurrences(t, "aa"), t="aaaa") == 2


def test_technologies(value):
    assert value(P.infer_technologies, t="We use ROS and lidar, SLAM; autonomous navigation") == ["ROS", "LiDAR", "SLAM", "Autonomous Navigation", "Autonomous Systems"]
    got = value(lambda t: P.infer_technologies(t, F.array(F.lit("Deep Learning"))), t="deep learning and cuda")
    assert got == ["Deep Learning", "CUDA"]


def test_industry(value):
    v = lambda label, tech, text: value(lambda t: P.validate_industry(F.lit(label), F.array(*map(F.lit, tech)).cast("array<string>"), t), t=text)
    assert v("Documents", ["Computer Vision", "OpenCV"], "text") == "Computer Vision AI"
    assert v("Robotics", [], "we like robotics") == "Robotics"
    assert v("Unanchored Words", [], "logistics company") == "Logistics"
    assert v("", [], "nothing here") == ""


def test_product_cleaning(value):
    text = "FleetOS runs NavCore and the SwarmHub on every site"
    clean = lambda *xs: value(lambda t: P.clean_products(F.array(*map(F.lit, xs)), t), t=text)
    assert clean("FleetOS", "Our NavCore", "the platform", "Ghost Product", "SwarmHub", "Introducing FleetOS", "FleetOS") == ["FleetOS", "SwarmHub"]
    assert value(P.rescue_products, t="Our platform FleetOS ships. NaviCore is a sensor. Nothing Here") == ["FleetOS", "NaviCore"]


def test_reply(value):
    raw = '```json\n{"products": ["A"], "industry": ["Robotics", "x"], "technologies": [], "services": ["B"], "use_cases": []}\n```'
    got = value(P.parse_reply, r=raw)
    assert got["industry"] == "Robotics" and got["products"] == ["A"] and got["services"] == ["B"]
    assert value(P.parse_reply, r="no json") is None and value(P.parse_reply, r=None) is None


def test_budget(value):
    text = "few words here. FleetOS is named. sensors matter. " + "z" * 200
    got = value(lambda t: P.relevant_text(t, 160), t=text)
    assert got.startswith("FleetOS is named. sensors matter. few words here.") and len(got) <= 160


def test_confidence(value):
    none = F.array().cast("array<string>")
    assert value(lambda _: S.fallback_confidence(none, F.lit(""), none), x=1) == 0.3
    many = F.array(*map(F.lit, ("LiDAR", "SLAM", "ROS2", "CUDA", "OpenCV")))
    assert value(lambda _: S.fallback_confidence(many, F.lit("Robotics"), many), x=1) == 0.4
    assert value(lambda t: S.extraction_confidence(F.lit(3), many, many, F.lit("x"), many, t), t="a" * 2000) == 0.98


def test_records(spark):
    text = "Acme Flow platform includes routing tools. It supports large teams. Write to x@y.example. 12 Main Street"
    row = R.company_record(spark.createDataFrame([("Acme", "acme.example", text), ("Nil", "", None)], "company string, website string, text string")).orderBy("company_name").collect()
    assert row[0]["products"] and "Acme Flow" in row[0]["products"] and row[0]["contact_email"] == "x@y.example"
    assert row[1]["products"] is None and row[1]["website"] is None


def test_bigrams(value):
    assert "drone platform" in value(R.product_bigrams, t="Our drone platform works")
    got = value(lambda t: R.finalized(R.titled_products(R.product_bigrams(t))), t="We sell a drone platform")
    assert [x["name"] for x in got] == ["Drone Platform"]


PAGES = "website string, `all` string, products string, services string, specifications string, quality string"


def test_pipeline(spark):
    roster = spark.createDataFrame([(0, "A", "a.example"), (1, "B", "b.example"), (2, "C", "c.example"), (3, "D", "a.example")], "ord long, name string, website string")
    good = "Autonomous drone navigation with lidar and slam for warehouse automation. " * 20
    pages = spark.createDataFrame([("a.example", good, "", "", "", "GOOD"), ("b.example", "short", "", "", "", "FAILED")], PAGES)
    rows = {r["ord"]: r for r in ranking.outcomes(roster, pages, offline=True).collect()}
    assert rows[1]["skip_reason"] == "too_short" and rows[2]["skip_reason"] == "crawl_error"
    assert rows[0]["score"] == rows[3]["score"] > 50 and rows[0]["breakdown"]["use_case"] == 19.0
    ranked = [r["ord"] for r in ranking.rank_companies(roster, pages, offline=True).collect()]
    assert ranked == [0, 3]
    penalised = ranking.rank_companies(roster, pages).first()
    assert penalised["score"] == pytest.approx(max(0, round(sum(rows[0]["breakdown"]) * 0.6 - 10, 2)))


def test_pipeline_with_a_model(spark):
    roster = spark.createDataFrame([(0, "A", "a.example"), (1, "B", "b.example")], "ord long, name string, website string")
    text = "FleetOS plans paths. Our robotics stack uses lidar for warehouse automation. " * 20
    pages = spark.createDataFrame([("a.example", text, "", "", "", "GOOD"), ("b.example", text, "", "", "", "GOOD")], PAGES)
    reply = F.when(F.col("website") == "a.example", '{"products": ["FleetOS"], "technologies": ["LiDAR"], "industry": "Robotics", "use_cases": [], "services": []}').otherwise("busy")
    rows = {r["website"]: r for r in ranking.outcomes(roster, pages, extractor=lambda df: df.withColumn("reply", reply)).collect()}
    assert rows["a.example"]["products"] == ["FleetOS"] and rows["a.example"]["extracted"] and not rows["b.example"]["extracted"]


def test_profiles_rank_with_defaults(spark):
    roster = spark.createDataFrame([(0, "A", "a"), (1, "B", "b"), (2, "C", "c")], "ord long, name string, website string")
    profiles = spark.createDataFrame([("a", "we build houses", "Construction"), ("b", "autonomous drones with lidar", "Robotics")], "website string, text string, industry string")
    got = ranking.rank_profiles(roster, profiles).collect()
    assert [r["name"] for r in got] == ["B", "A", "C"] and got[2]["score"] == 0.0 and got[2]["reason"] == L.WEAK_REASON.format(target=L.TARGET)
