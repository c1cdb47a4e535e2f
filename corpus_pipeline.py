"""A training corpus from raw documents: five stages, each written and read again.

Toxic documents go; of each group of near duplicates one document stays; repeated passages
are cut out of what is left; documents with benchmark passages go; the rest is encoded.
All stages but the last return the columns of their input, whatever their names and order,
and take an empty table, very long texts and nulls in any column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rosterlens.llm import decontam, jaccard_join, piece_lattice, suffix_dedup, toxicity
from rosterlens.llm.queries import vocabulary
from rosterlens.llm.shared import stored

#: SQL can't express the trained and sampled stages; tests hold them against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic. Null and empty texts stay; repeated rows fare alike."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group linked at 0.8 on five-word shingles.

    Of repeated rows one stays, of equal texts the least id; a null id counts as the largest.
    Texts without words (null and empty ones) all stay.
    """
    return jaccard_join.representatives(docs, words=5, num=8, den=10)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that a smaller id has; texts of which nothing is left go.

    A character cut through by such a string stays whole. Null and empty texts stay as they
    are; rows that repeat an id don't cut each other. ``n_chars`` is counted anew.
    """
    return suffix_dedup.clean(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item. Null and empty texts stay; repeated rows fare alike."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of each document, and that they decode to its text; null and empty texts have none."""
    return piece_lattice.encode(docs, vocabulary("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
