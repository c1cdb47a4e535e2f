"""Embeddings, cosine likeness, and a classifier by descriptions."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.arrays import let
from ..functions.text import strip

SIZE = 256


def token_counts(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, token, n) of lowered alphanumeric tokens."""
    return docs.select(id_col, F.explode(tokens(F.col(text_col))).alias("token")).groupBy(id_col, "token").agg(F.count("*").alias("n"))


def tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[a-zA-Z0-9]+"), F.lit(0)), F.lower)


def hash_vector(text: Column, size: int = SIZE, slot: Callable[[Column], Column] = F.xxhash64) -> Column:
    """Token counts by hash bucket; the same in every process. ``slot`` gives a token's hash."""
    slots = F.transform(tokens(text), lambda t: F.pmod(slot(t), F.lit(size)).cast("int"))

    # Each slot is there once more than it was met, so that its run is found at its own place.
    every = F.concat(slots, F.sequence(F.lit(0), F.lit(size - 1)))

    def count(ordered: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(ordered)), lambda i: (i == F.size(ordered)) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        return let(ends, lambda e: F.transform(e, lambda end, i: (end - F.when(i == 0, 0).otherwise(F.get(e, i - 1)) - 1).cast("double")))

    return let(F.sort_array(every), count)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors and for those without length."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def semantic_score(likeness: Column) -> Column:
    return F.round(F.greatest(F.least(likeness, F.lit(1.0)), F.lit(0.0)) * 100, 2)


def semantic_scores(docs: DataFrame, query: str, text_col: str = "text", embed: Callable[[Column], Column] = hash_vector) -> DataFrame:
    """``docs`` with the score of each text against one query; a blank query scores 0."""
    if not (query or "").strip():
        return docs.withColumn("semantic_score", F.lit(0.0))
    return docs.withColumn("semantic_score", semantic_score(cosine(embed(F.col(text_col)), embed(F.lit(query)))))


def cached_embeddings(docs: DataFrame, cache: DataFrame, text_col: str = "text", embed: Callable[[Column], Column] = hash_vector, most: int = 1200) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``embedding``, from the cache ``(key, embedding)`` where it has one; and the new cache rows.

    Keys are sha1 of the stripped, cut text. A vector of no length in the cache is a miss. Texts meet the cache in one join; a
    cache that is a table bucketed by key isn't shuffled for it, and keys that texts lack are sifted out by Spark's runtime filters.
    """
    cut = F.substring(strip(F.coalesce(F.col(text_col), F.lit(""))), 1, most)
    keyed = docs.withColumn("key", F.sha1(cut.cast("binary")))
    good = cache.filter(F.size("embedding") > 0).select("key", "embedding").dropDuplicates(["key"]).withColumnRenamed("embedding", "__kept")
    met = keyed.join(good, "key", "left")
    fresh = met.filter("__kept is null").select("key", cut.alias("cut")).dropDuplicates(["key"]).select("key", embed(F.col("cut")).alias("embedding"))
    whole = met.withColumn("embedding", F.when(F.col("__kept").isNotNull(), F.col("__kept").cast("array<double>")).otherwise(embed(cut).cast("array<double>"))).drop("__kept")
    return whole, fresh


def classify(docs: DataFrame, text_col: str = "text", categories=L.CLASSIFIER, embed: Callable[[Column], Column] = hash_vector, hint: float = 0.03) -> DataFrame:
    """``docs`` with ``industry`` and its ``confidence``: likeness to a description plus hints for words present."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.withColumns({"__v": embed(text), "__low": F.lower(text)})
    # Vectors of the descriptions are made once, not for each text; so is the text's own product.
    known = docs.sparkSession.range(1).select(*(embed(F.lit(d)).cast("array<double>") for _, d, _ in categories)).first()
    rows = [{"at": -i, "label": name, "v": known[i], "square": sum(x * x for x in known[i]), "words": list(w), "slots": [k for k, x in enumerate(known[i]) if x]} for i, (name, _, w) in enumerate(categories)]
    options = F.from_json(F.lit(json.dumps(rows)), "array<struct<at: int, label: string, v: array<double>, square: double, words: array<string>, slots: array<int>>>")

    def likeness(v: Column, square: Column, o: Column) -> Column:
        product = F.aggregate(o["slots"], F.lit(0.0), lambda acc, k: acc + F.get(v, k).cast("double") * F.get(o["v"], k))
        return let(F.sqrt(square * o["square"]), lambda norm: F.when((F.size(v) == 0) | (norm == 0), 0.0).otherwise(product / norm))

    def scored(x: Column) -> Column:
        held = lambda o: F.size(F.filter(o["words"], lambda w: x["low"].contains(w)))
        return F.transform(options, lambda o: F.struct((likeness(x["v"], x["square"], o) + held(o) * hint).alias("score"), o["at"].alias("at"), o["label"].alias("label")))

    v = F.col("__v")
    best = F.array_max(let(F.struct(v.alias("v"), dot(v, v).alias("square"), F.col("__low").alias("low")), scored))
    blank = strip(text) == ""
    docs = docs.withColumn("__b", best)
    confidence = F.round(F.greatest(F.least(F.col("__b.score"), F.lit(1.0)), F.lit(0.0)), 4)
    return docs.withColumns({"industry": F.when(blank, "Other").otherwise(F.col("__b.label")), "confidence": F.when(blank, 0.0).otherwise(confidence)}).drop("__v", "__low", "__b")


def nearest_centroid(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, size: int) -> DataFrame:
    """(id, nearest, likeness): the label whose mean vector is nearest by cosine.

    Centroids are as many as labels, 1000 at most; each vector is compared with all of them.
    """
    per = vectors.groupBy(label_col).agg(*(F.avg(F.get(vector_col, F.lit(i)).cast("double")).alias(f"c{i}") for i in range(size)))
    centroids = per.select(F.col(label_col).alias("label"), F.array(*(F.col(f"c{i}") for i in range(size))).alias("centre"))
    few = [(r["label"], list(r["centre"])) for r in centroids.orderBy("label").limit(1001).collect()]
    if len(few) > 1000:
        raise ValueError("too many labels to compare each vector with; cluster the labels first")
    kind = vectors.schema[label_col].dataType.simpleString()
    rows = [{"at": -i, "label": label, "unit": [x / (sum(y * y for y in c) ** 0.5 or 1.0) for x in c]} for i, (label, c) in enumerate(few)]
    options = F.from_json(F.lit(json.dumps(rows)), f"array<struct<at: int, label: {kind}, unit: array<double>>>")
    norm = F.sqrt(dot(F.col(vector_col), F.col(vector_col)))
    scored = let(norm, lambda n: F.transform(options, lambda o: F.struct(F.round(F.when(n == 0, 0.0).otherwise(dot(F.col(vector_col), o["unit"]) / n), 9).alias("s"), o["at"].alias("at"), o["label"].alias("label"))))
    best = vectors.select(id_col, F.array_max(scored).alias("b"))
    return best.select(id_col, F.col("b.label").alias("nearest"), F.round("b.s", 6).alias("likeness"))


def embed_with(docs: DataFrame, load: Callable[[], Callable[[Sequence[str]], Sequence[Sequence[float]]]], text_col: str = "text", out_col: str = "embedding") -> DataFrame:
    """``docs`` with vectors from a model that ``load`` brings up once per worker."""
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for b in batches:
            yield pd.Series([list(map(float, v)) for v in model(b.fillna("").tolist())])

    return docs.withColumn(out_col, F.pandas_udf(run, "array<double>", F.PandasUDFType.SCALAR_ITER)(F.col(text_col)))
