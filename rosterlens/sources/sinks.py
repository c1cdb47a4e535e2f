"""Writers: results as CSV and JSON, caches, and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.arrays import split_values
from ..functions.text import strip
from .folders import work_folder
from .readers import CSV_COLUMNS

_PRODUCTS = "array<struct<name: string, specifications: string>>"
JSON_COLUMNS = (
    "name", "website", "score", "category", "breakdown", "confidence", "industry", "products", "services", "technologies",
    "use_cases", "product_specifications", "price_range", "contact_email", "phone", "summary", "recommended_products", "reason",
)


def products_json(names: Column) -> Column:
    """Names as JSON text of objects; null for none."""
    return F.when(F.size(names) > 0, F.to_json(F.transform(names, lambda n: F.struct(n.alias("name"), F.lit("").alias("specifications")))))


def parse_products(value: Column) -> Column:
    """Objects from JSON text, or from names between commas where it isn't a list."""
    listed = F.when(strip(value).startswith("["), F.from_json(value, _PRODUCTS))
    plain = F.transform(split_values(value), lambda n: F.struct(n.alias("name"), F.lit("").alias("specifications")))
    tidy = F.transform(listed, lambda x: F.struct(strip(F.coalesce(x["name"], F.lit(""))).alias("name"), strip(F.coalesce(x["specifications"], F.lit(""))).alias("specifications")))
    good = F.filter(tidy, lambda x: x["name"] != "")
    return F.coalesce(good, plain, F.array().cast(_PRODUCTS))


def validated(df: DataFrame) -> DataFrame:
    """Scores and confidence to four places, products as objects."""
    products = F.col("products")
    if dict(df.dtypes)["products"] == "string":
        products = parse_products(products)
    return df.withColumns({"score": F.round("score", 4), "confidence": F.round("confidence", 4), "products": products})


def csv_columns(df: DataFrame) -> list[Column]:
    """Twenty columns of text and numbers: nulls as "", lists between commas, objects as JSON."""
    kinds = dict(df.dtypes)
    cols = []
    for c in CSV_COLUMNS:
        kind = kinds.get(c, "string")
        value = F.col(c) if c in kinds else F.lit(None).cast("string")
        if kind.startswith("array<struct") or kind.startswith("struct"):
            value = F.when(F.size(value) > 0, F.to_json(value)) if kind.startswith("array") else F.to_json(value)
        elif kind.startswith("array"):
            value = F.array_join(value, ", ")
        elif kind in ("double", "float") or kind.startswith("decimal"):
            cols.append(value.cast("double").alias(c))
            continue
        cols.append(F.coalesce(value.cast("string"), F.lit("")).alias(c))
    return cols


def csv_rows(df: DataFrame) -> DataFrame:
    return df.select(*csv_columns(df))


def json_columns(df: DataFrame) -> list[Column]:
    """Eighteen columns; products by name, nulls kept."""
    kinds = dict(df.dtypes)
    names = F.transform("products", lambda p: p["name"]) if kinds["products"].startswith("array<struct") else F.col("products")
    columns = {"name": F.col("company_name"), "products": names}
    return [(columns[c] if c in columns else F.col(c) if c in kinds else F.lit(None).cast("string")).alias(c) for c in JSON_COLUMNS]


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(*json_columns(df))


def _order(df: DataFrame, order: str) -> list[Column]:
    return [F.desc("score"), *([F.asc(order)] if order in df.columns else [])]


def write_csv(df: DataFrame, path: str, order: str = "ord") -> None:
    """CSV files in order of rank: their concatenation by name is the list, with the header as its first line.

    Each task writes the part of the order that it holds. ``readers.read_csv`` reads them back; Spark's own
    reader, told of a header, would take the first line of every file for one.
    """
    checked = validated(df)
    line = F.to_csv(F.struct(*csv_columns(checked)), {"escape": '"', "emptyValue": "", "nullValue": ""}).alias("line")
    keys = [F.col("score").alias("__score"), (F.col(order) if order in df.columns else F.lit(0)).alias("__order")]
    body = checked.select(F.lit(True).alias("__body"), *keys, line)
    head = df.sparkSession.range(1).select(F.lit(False), *(F.lit(None).cast(f.dataType) for f in body.schema.fields[1:3]), F.lit(",".join(CSV_COLUMNS)))
    head.toDF(*body.columns).union(body).orderBy("__body", F.desc("__score"), "__order").select("line").write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str, order: str = "ord") -> None:
    """JSON lines in order of rank."""
    json_rows(validated(df.orderBy(*_order(df, order)))).write.mode("overwrite").json(path, ignoreNullFields=False)


def write_json_parts(df: DataFrame, path: str, order: str = "ord") -> None:
    """Text files whose concatenation by name is one indented JSON array in order of rank."""
    from ..operators.rank import positions

    checked = validated(positions(df, _order(df, order), "__position"))
    text = F.to_json(F.struct(*json_columns(checked)), {"ignoreNullFields": "false", "pretty": "true"})
    n = checked.agg(F.max("__position").alias("n")).first()["n"] or 0
    comma = F.when(F.col("__position") < n, ",").otherwise("")
    rows = checked.select(F.col("__position").alias("at"), F.concat(F.lit("  "), F.replace(text, F.lit("\n"), F.lit("\n  ")), comma).alias("line"))
    ends = df.sparkSession.createDataFrame([(0, "["), (n + 1, "]")], "at long, line string")
    ends.union(rows).orderBy("at").select("line").write.mode("overwrite").text(path)


def write_json_array(df: DataFrame, path: str, order: str = "ord") -> None:
    """One file with an indented JSON array: parts written by tasks, then joined byte by byte."""
    folder = work_folder(df.sparkSession, "array")
    write_json_parts(df, folder, order)
    join_files(df.sparkSession, folder, path)


def join_files(spark: SparkSession, folder: str, path: str) -> None:
    """The part files of a folder, one behind the other by name, in one file. They are streamed, not held."""
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    source, target = hadoop.fs.Path(folder), hadoop.fs.Path(path)
    store = source.getFileSystem(conf)
    parts = sorted(f.getPath().toString() for f in store.listStatus(source) if f.getPath().getName().startswith("part-"))
    out = target.getFileSystem(conf).create(target, True)
    try:
        for part in parts:
            stream = store.open(hadoop.fs.Path(part))
            try:
                hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
            finally:
                stream.close()
    finally:
        out.close()


def write_embeddings(rows: DataFrame, cache_path: str) -> None:
    """Append new (key, embedding) rows, as ``cached_embeddings`` gives them, to a cache of vectors."""
    rows.select("key", "embedding").filter(F.size("embedding") > 0).write.mode("append").parquet(cache_path)


def write_embeddings_table(rows: DataFrame, table: str, path: str | None = None, buckets: int = 64) -> None:
    """Append new (key, embedding) rows to a table bucketed by key, with which texts meet without a shuffle of the cache."""
    good = rows.select("key", "embedding").filter(F.size("embedding") > 0).repartition(buckets, "key")
    writer = good.write.mode("append").bucketBy(buckets, "key").sortBy("key")
    (writer.option("path", path) if path else writer).saveAsTable(table)


#: Columns of a cache's folders: into how many parts keys are dealt, and which one.
CACHE_PARTS = ("buckets", "bucket")


def upsert_cache(spark: SparkSession, cache_path: str, new: DataFrame, key: str = "website_key", at: str = "cached_at", buckets: int = 64) -> DataFrame:
    """Put rows into a cache of one row a key, the latest, and return it.

    The cache is dealt to folders by a hash of the key. Only folders that new rows fall into are read, and replaced once their
    latest rows are written; files of the others stay. A cache keeps the number of folders that it was begun with.
    """
    from ..operators.roster import keep_last

    old = read_cache(spark, cache_path, new.schema)
    if old is not None:
        buckets = old.select("buckets").first()["buckets"]
    dealt = new.withColumns({"buckets": F.lit(buckets), "bucket": F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")})
    touched = [r["bucket"] for r in dealt.select("bucket").distinct().collect()]  # as many as there are folders at most
    if touched:
        rows = dealt if old is None else old.filter(F.col("bucket").isin(touched)).unionByName(dealt)
        latest = keep_last(rows, [key, *CACHE_PARTS], at).repartition("bucket")
        latest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*CACHE_PARTS).parquet(cache_path)
    out = read_cache(spark, cache_path, new.schema)
    return new.limit(0) if out is None else out.drop(*CACHE_PARTS)


def read_cache(spark: SparkSession, cache_path: str, schema: StructType) -> DataFrame | None:
    """The rows of a cache that ``upsert_cache`` has written, with their folders; None where there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.schema(StructType([*schema.fields, *(StructField(c, IntegerType()) for c in CACHE_PARTS)])).parquet(cache_path)


def fresh_rows(spark: SparkSession, cache_path: str, schema: StructType, keys: DataFrame, as_of: Column, key: str = "website_key", at: str = "cached_at", hours: int = 24) -> DataFrame | None:
    """A cache's rows of the wanted keys that aren't older than the limit; only folders of those keys are read."""
    from ..operators.roster import fresh

    cache = read_cache(spark, cache_path, schema)
    if cache is None:
        return None
    first = cache.select("buckets").first()
    if first is None:
        return cache.drop(*CACHE_PARTS)
    wanted = keys.select(key).distinct().withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(first["buckets"])).cast("int"))
    touched = [r["bucket"] for r in wanted.select("bucket").distinct().collect()]
    return fresh(cache.filter(F.col("bucket").isin(touched)).join(wanted.select(key), key, "left_semi").drop(*CACHE_PARTS), as_of, at, hours)


# ----------------------------------------------------------------------------- reports


def pipeline_report(outcomes: DataFrame, reason: str = "skip_reason") -> DataFrame:
    """One row: all, ranked, skipped by reason, and the share ranked."""
    return outcomes.agg(
        F.count("*").alias("total"), F.count_if(F.col(reason).isNull()).alias("ranked"), F.count_if(F.col(reason) == "crawl_error").alias("crawl_errors"),
        F.count_if(F.col(reason) == "too_short").alias("too_short"), F.count_if(F.col(reason) == "no_signal").alias("no_signal"),
        F.round(100.0 * F.count_if(F.col(reason).isNull()) / F.greatest(F.count("*"), F.lit(1)), 1).alias("percent"),
    )


#: Below this a model's profile counts as weak. Fixed value.
LEAST_CONFIDENCE = 0.45


def write_observed(outcomes: DataFrame, path: str, reason: str = "skip_reason", extracted: str = "extracted", confidence: str = "confidence") -> DataFrame:
    """Write outcomes and return their report, gathered by the same pass: one row.

    Besides what is skipped it counts the degraded rows that are ranked with a penalty: those whose profile comes from keywords for want
    of a model's (``llm_fallback``, also of rows then found to hold nothing), and a model's weak ones (``low_confidence``).
    """
    why, ok = F.col(reason), F.coalesce(F.col(extracted), F.lit(False))
    ranked, weak = why.isNull(), F.coalesce(F.col(confidence), F.lit(0.0)) < LEAST_CONFIDENCE
    seen = Observation()
    outcomes.observe(
        seen, F.count(F.lit(1)).alias("total"), F.count_if(ranked).alias("ranked"), *(F.count_if(F.coalesce(why == c, F.lit(False))).alias(f"{c}s" if c == "crawl_error" else c) for c in ("crawl_error", "too_short", "no_signal")),
        F.count_if(ranked & ok & ~weak).alias("full"), F.count_if(~ok & (ranked | F.coalesce(why == "no_signal", F.lit(False)))).alias("llm_fallback"), F.count_if(ranked & ok & weak).alias("low_confidence"),
    ).write.mode("overwrite").parquet(path)
    row = seen.get
    total = row["total"]
    return outcomes.sparkSession.createDataFrame([(*row.values(), round(100.0 * row["ranked"] / max(total, 1), 1))], ", ".join(f"{c} long" for c in row) + ", percent double")


def call_metrics(calls: DataFrame, ok: Column, retried: Column, seconds: str) -> DataFrame:
    """One row over a log of model calls. Timeouts count every failure, as the failures do."""
    n = F.count("*")
    return calls.agg(
        n.alias("calls"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.count_if(~ok).alias("timeouts"), F.count_if(retried).alias("retried"),
        F.round(F.avg(seconds), 4).alias("mean_seconds"), F.round(100.0 * F.count_if(ok) / F.greatest(n, F.lit(1)), 2).alias("success_rate"),
    )
