"""The registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of an installed vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Rules of the URL query: action, host/path. Fixed values.
URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items", "text_hash", "text_hash2")


def op5_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled page (its id is the label's doc_id) is bad if it is toxic or of low quality."""
    from . import host_reputation

    labels = _table(spark, sf_dir, "labels")
    bad = (F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)
    outcomes = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return host_reputation.judge(_table(spark, sf_dir, "pages"), outcomes, URL_RULES)


def op3_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram_lm

    return ngram_lm.score(_table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup

    return suffix_dedup.dedup(_table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard_join

    return jaccard_join.classes(_table(spark, sf_dir, "documents"), words=3, num=9, den=10)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import media
    from .shared import stored

    # The containers are files' contents: written to the shared folder and read from there.
    return media.read_back(stored(media.stored_texts(_table(spark, sf_dir, "documents")), "media"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_token_shards(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    from . import token_shards

    return token_shards.round_trip(_table(spark, sf_dir, "documents"), tokenizer or vocabulary("byte_bpe_50k.json"))


def op8_piece_lattice(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    from . import piece_lattice

    return piece_lattice.encode(_table(spark, sf_dir, "documents"), model or vocabulary("piece_bpe_32k.model"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import collocations

    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import vector_codes

    return vector_codes.encode(_table(spark, sf_dir, "embeddings"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_rules

    return line_rules.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from . import sql

    return dict(sql.ORACLES)
