"""One batch: a roster file in, a ranked list, a report and a cache of pages out."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import urls as U
from ..operators import crawl as C
from ..operators import profile as P
from ..operators import roster as O
from ..sources import readers, sinks
from . import ranking

PAGE_COLUMNS = ("all", "products", "services", "specifications", "quality")


def page_texts(roster: DataFrame, pages: DataFrame | None, cache: str | None, as_of: datetime, hours: int = 24, **crawl_options) -> DataFrame:
    """(website, ``PAGE_COLUMNS``): from the cache where it is fresh, else crawled anew and put into it.

    ``pages`` is a table of fetched pages (url, html); without one the sandbox makes them up.
    """
    spark = roster.sparkSession
    sites = roster.select("website").distinct().withColumn("website_key", U.cache_key(F.lower("website")))
    have = _cached(spark, cache)
    hits = None
    if have is not None:
        hits = O.fresh(have, F.lit(as_of), "cached_at", hours)
        sites_left = O.unseen(sites, hits, "website_key")
    else:
        sites_left = sites
    made = C.sandbox_pages(sites_left) if pages is None else C.page_map(C.crawl(sites_left, pages, **crawl_options))
    made = made.select("website", U.cache_key(F.lower("website")).alias("website_key"), *PAGE_COLUMNS, F.lit(as_of).cast("timestamp").alias("cached_at"))
    if cache is None:
        return made.select("website", *PAGE_COLUMNS)
    # Written before they are used, so that no page is crawled twice.
    made.write.mode("append").parquet(cache)
    latest = O.fresh(O.keep_last(spark.read.parquet(cache), ["website_key"], "cached_at"), F.lit(as_of), "cached_at", hours)
    return sites.join(latest.drop("website"), "website_key").select("website", *PAGE_COLUMNS)


def _cached(spark: SparkSession, cache: str | None) -> DataFrame | None:
    if cache is None:
        return None
    place = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return O.keep_last(spark.read.parquet(cache), ["website_key"], "cached_at")


CALLED = StructType().add("reply", "string").add("call_ok", "boolean").add("call_retried", "boolean").add("call_seconds", "double")


def within(seconds: float | None, call: Callable[[], str | None]) -> str | None:
    """What ``call`` returns; TimeoutError after so many seconds, when its thread is left behind."""
    if seconds is None:
        return call()
    got: list = []

    def work() -> None:
        try:
            got.append((call(), None))
        except Exception as e:  # noqa: BLE001 - raised where it is waited for
            got.append((None, e))

    thread = threading.Thread(target=work, daemon=True)
    thread.start()
    thread.join(seconds)
    if not got:
        raise TimeoutError(f"no answer within {seconds} s")
    value, error = got[0]
    if error is not None:
        raise error
    return value


def model_extractor(load: Callable[[], Callable[[str], str | None]], lengths: tuple[int, ...] = (900, 600), text_col: str = "text", seconds: float | None = 25.0) -> Callable[[DataFrame], DataFrame]:
    """An extractor for ``ranking.outcomes`` from a model that ``load`` brings up once per worker.

    The model gets the relevant part of a text, the longest first; an error, an empty answer or
    one without a JSON object is followed by a try with the next length. A row carries its
    answer, whether it came, whether it took another try, and the seconds. A call that raises or
    takes longer than ``seconds`` is a failed try, so a model that hangs doesn't hold a task.
    """

    def ask(df: DataFrame) -> DataFrame:
        tries = F.array(*(P.relevant_text(F.col(text_col), n) for n in lengths))

        def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import time

            model = load()
            for b in batches:
                rows = []
                for texts in b.column(b.num_columns - 1).to_pylist():
                    begun, reply, k = time.perf_counter(), None, 0
                    for k, text in enumerate(texts):  # noqa: B007 - the last place counts
                        try:
                            reply = within(seconds, lambda text=text: model(text))
                        except Exception:  # noqa: BLE001 - a failed call is a row without a reply
                            reply = None
                        if reply and "{" in reply and "}" in reply:
                            break
                        reply = None
                    rows.append((reply, reply is not None, k > 0, time.perf_counter() - begun))
                own = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.string(), pa.bool_(), pa.bool_(), pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *own], [*b.schema.names[:-1], *CALLED.fieldNames()])

        # A step of its own over whole rows, so that no later expression takes the call into itself.
        return df.withColumn("__tries", tries).mapInArrow(call, StructType([*df.schema.fields, *CALLED.fields]))

    return ask


def run(
    spark: SparkSession,
    roster_path: str,
    out: str,
    pages: DataFrame | None = None,
    cache: str | None = None,
    as_of: datetime | None = None,
    extractor: Callable[[DataFrame], DataFrame] | None = None,
    hours: int = 24,
    **options,
) -> dict[str, DataFrame]:
    """Rank a roster file; writes ``ranked_csv``, ``ranked_json``, ``ranked.json`` and ``outcomes`` below ``out``.

    Returns the input's health and, where that can be read, the ranked rows, the report of what was skipped and degraded, and, with
    a model, its metrics; of an input that can't be read there is its health alone. The list is written as CSV, as JSON lines and as one
    indented array. Nothing is written as ranked where no company qualifies. ``options`` go to ``ranking.outcomes``.
    """
    as_of = as_of or datetime.now()
    health = readers.health(spark, roster_path)
    state = health.first()
    if not (state["file_readable"] and state["row_count"]):
        return {"health": health}
    roster = readers.load_companies(spark, roster_path)
    texts = page_texts(roster, pages, cache, as_of, hours)
    path = f"{out.rstrip('/')}/outcomes"
    report = sinks.write_observed(ranking.outcomes(roster, texts, extractor, **options), path)
    done = spark.read.parquet(path)
    ranked = ranking.in_order(done.filter("skip_reason is null")).withColumnRenamed("name", "company_name")
    result = {"health": health, "ranked": ranked, "report": report}
    if "call_ok" in done.columns:
        calls = done.filter("call_ok is not null")
        result["calls"] = sinks.call_metrics(calls, F.col("call_ok"), F.col("call_retried"), "call_seconds")
    if not ranked.isEmpty():
        sinks.write_csv(ranked, f"{out.rstrip('/')}/ranked_csv")
        sinks.write_json(ranked, f"{out.rstrip('/')}/ranked_json")
        sinks.write_json_array(ranked, f"{out.rstrip('/')}/ranked.json")
    return result
