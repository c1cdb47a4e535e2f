"""Queries about names, replies, links and lists over whole given tables.

The tables' invented prose holds none of the words that these rules are about, so it is put into their words first: each of
``NEEDLES``, runs of letters that some texts have, stands for a sentence. Replies, labels and cells are dealt to rows by their keys.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..functions import urls as U
from ..functions.arrays import append_missing, distinct_ignoring_case, let, replace_each, split_values, without
from ..operators import crawl as C
from ..operators import html as H
from ..operators import profile as P
from ..operators import records as R
from ..operators import roster as O
from ..operators import score as S
from ..operators import vectors as V
from ..sources import readers, sinks
from . import ranking, service

Query = Callable[[SparkSession, str], DataFrame]
CASES: dict[str, Query] = {}


def case(f: Query) -> Query:
    CASES[f.__name__] = f
    return f


#: Texts of made-up firms: id, text.
TEXTS = (
    (1, "Harbor Nine builds drone inspection kits. The SkyLoom platform maps docks with LiDAR and SLAM. Our sensor software runs PyTorch at the edge."),
    (2, "We paint fences.\nCall us for a quote! Fences last for years."),
    (3, "A warehouse robot moves pallets. Warehouse automation needs path planning, object detection and a fleet management tool. The PalletPilot robot is quick."),
    (4, ""),
    (5, "Deep learning and machine learning for medical imaging. The MedGrid system reads scans; TensorFlow and CUDA help. Clinical teams use MedGrid daily."),
    (6, "Precision agriculture with crop monitoring from the air. Survey drones, aerial mapping and mapping tools. Crop data, crop maps, crop plans."),
    (7, "Software for retail checkout. Retail analytics and inventory management in one suite. ShopLoop and Till Mate are our product names, see the API device."),
    (8, "defense DEFENSE Defense surveillance: perimeter security, border security, surveillance towers and force protection. QX900 is a tactical device."),
    (9, "An automation engine called Orbit Weaver by Blue Fern. The Orbit Weaver engine uses neural networks, opencv and computer vision. Visual inspection at speed."),
    (10, "ros ros2 AMR amr agv uav uas ml. Autonomous navigation, autonomous mobile robot fleets and an edge ai sdk. RoverOS Nine, RoverOS and GridBot tools."),
    (11, None),
)
EXISTING = {1: ("Vision", "LiDAR"), 3: ("Robotics Kit",), 10: ("ROS2 Navigation", "Edge Computing")}
#: Items of model replies: id, products, technologies, services, use cases.
ITEMS = (
    (1, ("SkyLoom", "'SkyLoom Platform'", "The Kit", "drone kits", "Harbor Nine", "Edge Platform", "sensor"), ("LiDAR", "smart lidar", "Advanced Mapping", "innovation", "GPU cores"), ("Dock mapping", "consulting", "maps docks with drones daily ok", "Drone inspection"), ("map the docks", "maximize efficiency now", "Dock survey", "x")),
    (2, ("Fences", "Paint Kit", "Fence. Paint", ""), ("paint mixing", "RapidDry"), ("Fence painting", "we paint fences", "Quotes"), ("painting of long fences", "fences")),
    (3, ("PalletPilot", "PalletPilot Robot", "Moves Pallets", "PalletPilot", "Fleet Hub Suite One Two Three"), ("path planning", "Robot Arms", "object detection kit", "YOLO", "is Fast"), ("Pallet Suite", "Fleet management", "Warehouse Engine"), ("moves pallets in warehouses", "Seamless integration of tools")),
    (5, ("MedGrid", "Medgrid System", "Reading Scans", "Introducing MedGrid", "Scanned Images"), ("TensorFlow", "CUDA", "Medical Learning", "state tools", "deep learning"), ("Medical imaging", "Analytics", "the clinic"), ("medical imaging support is good", "clinical team planning")),
    (9, ("Orbit Weaver", "Orbit", "Weaver by Orbit", "Our Orbit", "Blue Fern Hub"), ("OpenCV", "neural networks", "Revolutionary Vision"), ("Visual inspection", "Speed Module", "Orbit Controller"), ("visual inspection at speed", "engines")),
    (10, ("RoverOS", "GridBot", "RoverOS Nine", "Digital Solutions", "rover"), ("ros2", "AMR", "edge ai", "Fleet Thing", "HTTPServer"), ("Fleets", "Rover SDK"), ("autonomous fleets of robots",)),
)
#: Labels proposed for the industry: id, label, technologies.
LABELS = (
    (1, "Marine Robotics", ("LiDAR", "SLAM")), (2, "Painting", ()), (2, "A long label about very many things", ()), (3, "Logistics", ("Object Detection",)), (4, "", ()), (5, "Insurance", ("TensorFlow",)),
    (6, "Farming", ()), (7, "Retail", ()), (7, "Banking", ()), (8, "", ()), (9, "Robotics", ("OpenCV", "Computer Vision")),
)
#: Raw replies of a model.
REPLIES = (
    (1, '{"products": ["A", "B"], "services": [], "technologies": ["T"], "use_cases": ["u v"], "industry": "Ports"}'), (2, "no object here"), (3, '```json\n{"products": ["C"], "industry": ["Farms", "Fields"]}\n```'),
    (4, 'Here it is: {"industry": "Mining"} as asked'), (5, '{"products": ["broken"'), (6, '{"products": [], "industry": ""}'), (7, None), (8, ""),
)
#: Numbers behind a confidence: id, names, products, technologies, industry, use cases, characters.
PROFILES = (
    (1, 0, 0, (), "", 0, 10), (2, 1, 2, ("LiDAR", "SLAM", "Paint"), "Ports", 1, 500), (3, 3, 5, ("PyTorch", "CUDA", "OpenCV", "YOLO", "AMR fleets", "IMU"), "Robots", 3, 2000),
    (4, 7, 9, ("a", "b", "c", "d", "e", "f", "g"), "X", 6, 1000), (5, 2, 1, ("deep learning", "machine learning"), "", 2, 1999),
)
#: Cells of a product column.
CELLS = (
    (1, '[{"name": "Kit ", "specifications": " 4 rotors"}, {"name": "", "specifications": "x"}]'), (2, "Kit, Loom , ,Till"), (3, None), (4, ""), (5, '[{"name": "Solo"}]'), (6, "[broken"),
)
#: Strings of a dashboard: id, text.
STRINGS = (
    (1, "Kit, folding arms; 4 rotors and a case"), (2, "  "), (3, None), (4, "one and two And three"), (5, "Fast. Light; strong, quiet. "), (6, "12.345"), (7, "-3"), (8, "nan"), (9, "The long way home"), (10, "plain words here"),
    (11, "six words are one too many here"), (12, "done!"),
)
PRODUCT_TEXTS = (
    (1, "The Acme Flow Platform supports dock maps, offers alerts. It includes a viewer.\nThe Acme Flow Platform supports dock maps, offers alerts. Other words follow."),
    (2, "Our service is plain. Gray Heron Suite is a product. These features include a log, a log and a map."), (3, "Meet Tidal Loop today. The Tidal Loop system is small. BrightDock enables maps."),
    (4, "Motion control robot software. The vision system and a motor controller.\nmodel 5 supports twelve axes at once\n• it offers cloud alerts every day"), (5, ""), (6, "Red Kite Product Services provide a platform, Red Kite Product features maps; Product Services is a solution."),
)


#: Runs of letters in the prose, each in a few hundredths of the texts.
NEEDLES = (
    "htitio", "lichtz", "mentei", "thenha", "thstsh", "thheen", "bekeit", "mentvi", "hwhing", "thshth", "theaan", "eringn", "onatti", "queier", "onbleo", "atshsh", "htiing", "thones", "ungber", "ntment",
    "nattio", "onoron", "heitzu", "reblee", "rtionh", "aukeit", "thener", "elleel", "erorin", "onthin", "thanwh", "thhees", "tionoi", "ellech", "lichun", "ntionb", "thonbl", "schkei", "eingwh", "iertio", "erthti", "iereau",
    "ngheit", "thanes", "thhaed",
)
#: What they stand for: the sentences of the firms' texts, and the texts about products.
PIECES = tuple(s for _, t in TEXTS if t for s in re.split(r"(?<=[.!?])\s", t)) + tuple(t for _, t in PRODUCT_TEXTS if t)


def worded(text: Column) -> Column:
    return replace_each(text, ((needle, f" {piece} ") for needle, piece in zip(NEEDLES, PIECES, strict=False)))


def _dealt(spark: SparkSession, df: DataFrame, rows: Sequence[tuple], schema: str, key: str = "doc_id") -> DataFrame:
    """``df`` beside the row of a small table, without its first column, that the remainder of the key tells."""
    table = _table(spark, [(i, *r[1:]) for i, r in enumerate(rows)], f"k int, {schema}")
    return df.join(F.broadcast(table), F.col("k") == F.col(key) % len(rows)).drop("k")


def _table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def _texts(spark: SparkSession, d: str, where: str = "true") -> DataFrame:
    """``where`` holds of the texts as they are: a condition on worded ones would have them worded twice."""
    return readers.spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")).filter(where).withColumn("text", worded(F.col("text")))


def _csv(items: Column) -> Column:
    return F.array_join(items, "|")


def profile(docs: DataFrame) -> DataFrame:
    p = P.fallback_profile(docs)
    return p.select("doc_id", F.array_join("technologies", ",").alias("technologies"), F.array_join("products", ",").alias("products"), "industry", F.array_join("use_cases", ",").alias("use_cases"), "confidence")


@case
def case_keyword_profiles(spark: SparkSession, d: str) -> DataFrame:
    return profile(_texts(spark, d))


@case
def case_technologies(spark: SparkSession, d: str) -> DataFrame:
    """Names that a profile already has come first and keep out others that hold them."""
    df = _dealt(spark, _texts(spark, d), [(k, list(v)) for k, v in EXISTING.items()], "existing array<string>")
    return df.select("doc_id", _csv(P.infer_technologies(F.col("text"), F.col("existing"))).alias("technologies"))


@case
def case_clean_names(spark: SparkSession, d: str) -> DataFrame:
    items = _dealt(spark, _texts(spark, d), [(i, *map(list, x)) for i, *x in ITEMS], "p array<string>, t array<string>, s array<string>, u array<string>")
    rescued, rest = P.rescue_from_services(F.col("s"))
    return items.select(
        "doc_id", _csv(P.clean_products(F.col("p"), F.col("text"))).alias("products"), _csv(P.clean_technologies(F.col("t"))).alias("technologies"), _csv(P.clean_services(F.col("s"), F.col("text"))).alias("services"),
        _csv(P.clean_use_cases(F.col("u"))).alias("use_cases"), _csv(rescued).alias("rescued"), _csv(rest).alias("rest"), _csv(P.grounded(F.col("p"), F.col("text"))).alias("grounded"),
    )


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name")


def _strings(spark: SparkSession, d: str) -> DataFrame:
    """Strings as they are for every third part, and before its name for the others."""
    df = _dealt(spark, _parts(spark, d), STRINGS, "s string", "p_partkey")
    return df.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, F.col("s")).otherwise(F.concat("s", F.lit(", "), "p_name", F.lit(" and One thing"))).alias("s"))


@case
def case_brand_tokens(spark: SparkSession, d: str) -> DataFrame:
    words = _texts(spark, d).select(F.explode(T.words(F.col("text"))).alias("word")).distinct()
    return words.select("word", P.brand_token(F.col("word")).alias("brand"))


@case
def case_industries(spark: SparkSession, d: str) -> DataFrame:
    labels = _dealt(spark, _texts(spark, d), [(i, label, list(t)) for i, label, t in LABELS], "label string, t array<string>")
    return labels.select("doc_id", "label", P.validate_industry(F.col("label"), F.col("t"), F.col("text")).alias("industry"))


@case
def case_replies(spark: SparkSession, d: str) -> DataFrame:
    r = P.parse_reply(F.col("reply"))
    parts = _dealt(spark, _parts(spark, d), REPLIES, "reply string", "p_partkey")
    df = parts.withColumn("reply", F.replace(F.replace("reply", F.lit('"A"'), F.concat(F.lit('"'), "p_name", F.lit('"'))), F.lit("Mining"), F.col("p_name"))).withColumn("r", r)
    return df.select(F.col("p_partkey").alias("doc_id"), F.col("r").isNotNull().alias("ok"), *(_csv(F.col(f"r.{c}")).alias(c) for c in ("products", "technologies", "use_cases")), F.col("r.industry").alias("industry"))


@case
def case_confidence(spark: SparkSession, d: str) -> DataFrame:
    df = _dealt(spark, spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), [(i, list(t), ind) for i, _, _, t, ind, _, _ in PROFILES], "t array<string>, industry string")
    many = lambda n: F.array_repeat(F.lit("x"), n.cast("int"))
    df = df.withColumns({"named": (F.col("doc_id") % 8).cast("int"), "p": many(F.col("doc_id") * 7 % 10), "u": many(F.col("doc_id") % 7)})
    return df.select("doc_id", S.extraction_confidence(*(F.col(c) for c in ("named", "p", "t", "industry", "u", "text"))).alias("extracted"), S.fallback_confidence(F.col("t"), F.col("industry"), F.col("u")).alias("fallback"))


@case
def case_gates(spark: SparkSession, d: str) -> DataFrame:
    """Texts too short for a model, and profiles in which nothing was found."""
    df = P.fallback_profile(_texts(spark, d))
    none = P.hopeless(F.when(F.size("technologies") == 0, 0.0).otherwise(F.col("confidence")), F.col("technologies"), F.col("industry"))
    return df.select("doc_id", P.too_short(F.col("text")).alias("short"), none.alias("hopeless"))


@case
def case_links(spark: SparkSession, d: str) -> DataFrame:
    """The pages' links in the forms that hrefs take."""
    found = spark.read.parquet(f"{d}/pages.parquet").select(F.col("url").alias("base"), F.posexplode(F.transform(H.links(F.col("html")), lambda x: x["href"])).alias("k", "link"))
    rest = F.expr("substring(link, 2)")
    forms = [F.col("link"), rest, F.concat(F.lit("../"), rest), F.concat(F.lit("./a/../"), rest), F.concat(F.lit("?r="), rest), F.concat(F.lit("#"), rest), F.concat(F.lit("//b.example"), "link"), F.concat(F.lit("mailto:"), rest)]
    href = F.element_at(F.array(*forms), ((F.col("k") + F.length("base")) % len(forms) + 1).cast("int"))
    return found.select("base", href.alias("href")).select("base", "href", U.resolve(F.col("base"), F.col("href")).alias("url"))


@case
def case_roster(spark: SparkSession, d: str) -> DataFrame:
    """A roster whose name column has the other spelling."""
    k = F.col("s_suppkey")
    firm, site = F.concat(F.lit("Firm "), k % 40), F.concat(F.lit("f"), k % 20, F.lit(".example"))
    name = F.when(k % 7 == 0, F.concat(F.lit(" "), F.lower(firm), F.lit(" "))).when(k % 7 == 3, "").otherwise(firm)
    website = F.when(k % 5 == 0, None).when(k % 5 == 1, F.concat(F.lit("https://www."), site, F.lit("/home"))).when(k % 5 == 2, F.concat(F.lit("http://"), site)).otherwise(site)
    sheet = spark.read.parquet(f"{d}/supplier.parquet").select(k.alias("n"), name.alias("Company Name"), website.alias("Website"))
    return O.clean_roster(sheet, "n").select(F.col("ord").alias("n"), "name", "website")


@case
def case_product_cells(spark: SparkSession, d: str) -> DataFrame:
    cells = _dealt(spark, _parts(spark, d), CELLS, "cell string", "p_partkey").select(F.col("p_partkey").alias("id"), F.replace("cell", F.lit("Kit"), F.col("p_name")).alias("cell")).withColumn("p", sinks.parse_products(F.col("cell")))
    back = sinks.products_json(F.transform("p", lambda x: x["name"]))
    return cells.select("id", _csv(F.transform("p", lambda x: F.concat(x["name"], F.lit(":"), F.coalesce(x["specifications"], F.lit(""))))).alias("products"), F.coalesce(back, F.lit("")).alias("json"))


@case
def case_strings(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("s")
    parts = T.product_parts(F.coalesce(t, F.lit("")))
    return _strings(spark, d).select(
        "id", F.coalesce(parts["name"], F.lit("")).alias("name"), F.coalesce(_csv(parts["features"]), F.lit("")).alias("features"), _csv(T.specification_parts(t)).alias("specs"), _csv(T.technology_parts(t)).alias("technologies"),
        T.safe_text(t, "none").alias("safe"), T.format_score(t).alias("percent"), T.clean_string(t).alias("clean"), T.with_full_stop(t).alias("stopped"), _csv(split_values(F.coalesce(t, F.lit("")))).alias("split"),
    )


@case
def case_lists(spark: SparkSession, d: str) -> DataFrame:
    """Union, difference and first-come lists over the words of the strings."""
    w = T.words(F.coalesce("s", F.lit("")))
    return _strings(spark, d).select(
        "id", _csv(append_missing(F.slice(w, 1, 2), w, 4)).alias("appended"), _csv(without(w, ["And", "the", "one"])).alias("without"), _csv(distinct_ignoring_case(w)).alias("distinct"),
        R.collapse_repeats(F.concat(F.coalesce("s", F.lit("")), F.lit(", "), F.coalesce("s", F.lit("")))).alias("collapsed"),
    )


@case
def case_product_records(spark: SparkSession, d: str) -> DataFrame:
    t, low = F.col("text"), F.col("low")
    named = F.transform(R.structured_products(t), lambda x: F.concat(x["name"], F.lit(":"), x["specifications"]))
    df = _texts(spark, d).withColumnRenamed("doc_id", "id").withColumn("low", F.lower(F.coalesce(t, F.lit("")))).withColumn("pairs", R.product_bigrams(t, low=low))
    return df.select(
        "id", _csv(named).alias("named"), _csv(F.col("pairs")).alias("bigrams"), _csv(F.transform(R.titled_products(F.col("pairs")), lambda x: x["name"])).alias("titled"),
        F.coalesce(R.record_technologies(t, low), F.lit("")).alias("technologies"), _csv(R.spec_lines(t, low=low)).alias("lines"), _csv(R.pattern_products(t, low=low)).alias("patterns"),
    )


@case
def case_sandbox(spark: SparkSession, d: str) -> DataFrame:
    sites = spark.read.parquet(f"{d}/pages.parquet").select(U.domain(F.col("url")).alias("website")).distinct()
    s = C.sandbox_pages(sites)
    return s.select("website", F.md5(F.col("all").cast("binary")).alias("digest"), "products", "quality")


@case
def case_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Which companies are ranked, and why the others aren't: no page, too short a text, no sign of anything."""
    texts = _texts(spark, d)
    roster = texts.select(F.col("doc_id").alias("ord"), F.concat(F.lit("Firm "), "doc_id").alias("name"), F.concat(F.lit("site"), "doc_id").alias("website"))
    long = F.repeat(F.concat("text", F.lit(" ")), F.when(F.col("doc_id") % 5 == 0, 1).otherwise(3))
    pages = _texts(spark, d, "text is not null and doc_id % 11 <> 4").select(F.concat(F.lit("site"), "doc_id").alias("website"), long.alias("all"), *(F.lit("").alias(c) for c in ("products", "services", "specifications")), F.lit("GOOD").alias("quality"), F.lit(1).alias("fetched"))
    return ranking.outcomes(roster, pages, order="fetched").select("ord", F.coalesce("skip_reason", F.lit("")).alias("skip_reason"))


@case
def ranked_profiles(spark: SparkSession, d: str) -> DataFrame:
    """A roster ranked by profiles; companies without one get the defaults."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    roster = docs.select(F.col("doc_id").alias("ord"), F.col("source").alias("name"), F.col("doc_id").cast("string").alias("website"))
    profiles = docs.join(spark.read.parquet(f"{d}/labels.parquet").filter("quality = 1").select("doc_id"), "doc_id", "left_semi")
    profiles = profiles.select(F.col("doc_id").cast("string").alias("website"), "text", F.col("source").alias("industry"), F.lit(0.7).alias("multiplier"), F.lit(5).alias("penalty"))
    return ranking.rank_profiles(roster, profiles, lexicon=L.TEST_LEXICON).select("ord", "score", "category", "breakdown.ai", "breakdown.domain")


@case
def summary_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    opening = T.summary_or_opening(t)
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", opening.alias("summary"), T.confidence_label(opening, 45, 140).alias("confidence"), T.spec_text(F.coalesce(t, F.lit(""))).alias("spec"))


@case
def cached_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of labelled texts come from a cache, the others are made anew."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    key = F.sha1(F.substring(T.strip(F.coalesce("text", F.lit(""))), 1, 1200).cast("binary"))
    cache = docs.join(labels.select("doc_id"), "doc_id", "left_semi").select(key.alias("key"), F.array(F.lit(-1.0)).alias("embedding"))
    cache = readers.embedding_cache(cache.withColumn("embedding", F.to_json("embedding")))
    out, fresh = V.cached_embeddings(docs, cache, embed=lambda t: F.array(F.length(t).cast("double")))
    return out.select("doc_id", "key", F.get("embedding", F.lit(0)).alias("value"))


@case
def letter_classifier(spark: SparkSession, d: str) -> DataFrame:
    """The classifier with vectors of letter counts, which SQL can count too."""
    count = lambda x: F.transform(F.array(*(F.lit(c) for c in "abcdefghijklmnopqrstuvwxyz")), lambda c: (x["n"] - F.length(F.replace(x["low"], c, F.lit("")))).cast("double"))
    letters = lambda t: let(F.struct(F.length(t).alias("n"), F.lower(t).alias("low")), count)
    docs = readers.spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))
    return V.classify(docs, embed=letters).select("doc_id", "industry", F.round("confidence", 3).alias("confidence"))


@case
def digest_vector(spark: SparkSession, d: str) -> DataFrame:
    """Token counts by bucket, with a hash that SQL has too."""
    v = V.hash_vector(F.col("text"), slot=lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 1, 4), 16, 10).cast("long"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.array_join(F.transform(v, lambda x: x.cast("int")), ",").alias("vector"))


@case
def csv_results(spark: SparkSession, d: str) -> DataFrame:
    """Ranked rows written as CSV and read as a service reads them."""
    path = sinks.work_folder(spark, "csv")
    sinks.write_csv(_result_rows(spark, d), path)
    return readers.load_results(spark, None, path).select("company_name", "website", "score", "products", "confidence", "reason")


@case
def json_results(spark: SparkSession, d: str) -> DataFrame:
    """Ranked rows written as JSON lines and read with defaults."""
    path = sinks.work_folder(spark, "json")
    sinks.write_json(_result_rows(spark, d), path)
    raw = readers.results_from_json(spark.read.json(path))
    return raw.select("company_name", "website", "score", "category", "industry", _csv(F.col("products")).alias("products"), "confidence", "summary", "reason")


def _result_rows(spark: SparkSession, d: str) -> DataFrame:
    s = spark.read.parquet(f"{d}/supplier.parquet")
    return s.select(
        F.when(F.col("s_acctbal") > 0, F.col("s_name")).otherwise(F.lit(" ")).alias("company_name"), F.concat(F.lit("site"), "s_suppkey").alias("website"), F.col("s_acctbal").cast("double").alias("score"),
        F.lit(None).cast("string").alias("category"), F.when(F.col("s_nationkey") > 12, F.lit("Trade")).alias("industry"), F.array("s_name").alias("names"), (F.col("s_nationkey") / 7).alias("confidence"), F.lit('say "so", then').alias("reason"),
    ).withColumn("products", F.transform("names", lambda n: F.struct(n.alias("name"), F.lit("").alias("specifications")))).drop("names")


@case
def cache_upserts(spark: SparkSession, d: str) -> DataFrame:
    """Events written to a cache in two turns; the latest of each key remains."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("website_key"), F.struct("ts", "event_id").alias("cached_at"), "value")
    path = sinks.work_folder(spark, "cache")
    sinks.upsert_cache(spark, path, e.filter("value < 50"))
    return sinks.upsert_cache(spark, path, e.filter("not coalesce(value < 50, false)")).select("website_key", F.col("cached_at.event_id").alias("event_id"), "value")


@case
def stale_pages(spark: SparkSession, d: str) -> DataFrame:
    """Events older than a day before the last one, or without a time."""
    e = spark.read.parquet(f"{d}/events.parquet")
    last = e.agg(F.max("ts").alias("last")).first()["last"]
    return e.groupBy(readers.stale(F.col("ts"), F.lit(last), 86_400).alias("stale")).agg(F.count("*").alias("n"))


@case
def dashboard_table(spark: SparkSession, d: str) -> DataFrame:
    """Companies as a dashboard shows them, by score."""
    rows = service.dashboard_rows(spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_name").alias("company_name"), F.concat(F.lit(" site"), "s_suppkey").alias("website"), F.col("s_acctbal").cast("string").alias("score"), F.col("s_suppkey").alias("ord")))
    return service.by_score(rows).select("company_name", "website", "score", service.website_label(F.col("website")).alias("label"))
