"""Streaming forms: page arrivals scored as they come, rosters deduplicated, caches kept."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.text import quality_flag
from ..functions.urls import roster_key
from ..operators.score import LEXICON, score_text
from ..sources.sinks import upsert_cache


def scored_stream(docs: DataFrame, text_col: str = "text", lexicon: Mapping = LEXICON) -> DataFrame:
    """Stateless: each text with its quality and fit score."""
    return docs.withColumns({"quality": quality_flag(F.col(text_col)), "score": score_text(F.coalesce(F.col(text_col), F.lit("")), lexicon)})


def deduplicated_roster(rows: DataFrame, website: str = "website", at: str = "at", delay: str = "1 hour") -> DataFrame:
    """The first row of each site within the watermark; state is bounded by it."""
    return rows.withColumn("site", roster_key(F.col(website))).withWatermark(at, delay).dropDuplicatesWithinWatermark(["site"])


def windowed_metrics(calls: DataFrame, at: str = "ts", window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Calls and failures of each window of time."""
    return calls.withWatermark(at, delay).groupBy(F.window(at, window).alias("window")).agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("failed"), F.avg("value").alias("mean_value"))


def cache_writer(rows: DataFrame, cache_path: str, checkpoint: str, key: str = "website_key", at: str = "cached_at") -> DataStreamWriter:
    """Append each batch to a cache; the latest row of a key is read by ``upsert_cache``'s rule."""

    def put(batch: DataFrame, _: int) -> None:
        upsert_cache(batch.sparkSession, cache_path, batch, key, at)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True)
