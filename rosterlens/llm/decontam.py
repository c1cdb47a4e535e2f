"""Benchmark decontamination by a prefix-filtered set join, in plain DataFrame operations.

An item's windows are its runs of ``window`` consecutive words (one window, if it has
fewer). A window is a set of shingles of three words (of all its words, if fewer). For
exact containment the prefix that a match can't do without is a single shingle: the one
that is rarest over all documents. Documents are read once more: each word position gives
its shingle, hash-joined with the windows' prefix shingles; the position of the shingle in
the window and both lengths bound where the window would lie; the words there are compared.

Only window tables are broadcast, in blocks of at most ``WINDOW_BLOCK`` distinct windows;
a larger benchmark takes more passes over the documents. Windows go by a digest of their
words; which items have them is joined at the end, so hits stay small however many items
share a window. Hits are grouped by the id and two hashes of the text, so a task that runs
again gives the same rows.

A null or empty text has no words. Repeated rows are reported each. Items with the same
words are all named. Items without words, and empty tables on either side, hit nothing.
Only the id and text columns of both tables are read; others may have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import named, stored

WINDOW = 10
SHINGLE = 3
WINDOW_BLOCK = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text whose A-Z are lowered; other letters keep their case."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), SEPARATOR), "")


def _key(array: str, at: Column, size: int) -> Column:
    return F.xxhash64(*(F.get(array, at + j) for j in range(size)))


#: What a document's hits are grouped by: its id and two hashes of its text.
DOC = ("doc_id", "text_hash", "text_hash2")


def _doc(id_col: str, text_col: str) -> list[Column]:
    text = named(text_col)
    return [named(id_col).alias(DOC[0]), F.xxhash64(text).alias(DOC[1]), F.xxhash64(F.lit(1), text).alias(DOC[2])]


def _windows(items: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """Windows of all items: win (words), wid (their digest), k, size (of a shingle), item."""
    split = items.select(named(item_col).cast("string").alias("item"), words(named(text_col)).alias("w")).filter("size(w) > 0")
    spans = split.select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))).alias("i"))
    wins = spans.select("item", F.slice("w", F.col("i"), window).alias("win")).distinct()
    # Words hold no space, so their joined text stands for them.
    return wins.select("item", "win", F.unhex(F.md5(F.array_join("win", " "))).alias("wid"), F.size("win").alias("k"), F.least(F.size("win"), F.lit(SHINGLE)).alias("size"))


def _matches(places: DataFrame, prefix: DataFrame, size: int, lengths: bool) -> DataFrame:
    """Verified windows of each document; with ``lengths``, also a row that ends each document.

    The position behind the last word has the key 0, which an empty window answers, so the
    same pass that finds windows also counts every document's words.
    """
    behind = F.col("i") == F.size("w")
    if lengths:
        none = F.array().cast("array<string>")
        stop = places.sparkSession.range(1).select(F.lit(0).cast("long").alias("key"), F.lit(0).alias("off"), none.alias("win"), F.lit(0).alias("k"), F.lit(None).cast("binary").alias("wid"))
        prefix = prefix.unionByName(stop)
    else:
        places = places.filter(~behind)
    at = F.col("i") - F.col("off")
    hit = (at >= 0) & (at + F.col("k") <= F.size("w")) & (F.slice("w", at + 1, F.col("k")) == F.col("win"))
    return (
        places.withColumn("key", F.when(behind, F.lit(0).cast("long")).otherwise(_key("w", F.col("i"), size)))
        .join(F.broadcast(prefix), "key").filter(hit)
        .select(*DOC, at.alias("start"), (at + F.col("k")).alias("end"), "wid", F.when(F.col("k") == 0, at).alias("n"))
    )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """Columns: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, and two hashes of the text."""
    if window < 1:
        raise ValueError("window must be at least 1")
    pairs = stored(_windows(items, item_col, item_text_col, window), "windows")
    wins = pairs.select("win", "wid", "k", "size").distinct()
    counts = {r["size"]: r["n"] for r in wins.groupBy("size").agg(F.count("*").alias("n")).collect()}
    texts = docs.select(*_doc(id_col, text_col), words(named(text_col)).alias("w"))
    places = texts.select(*DOC, "w", F.explode(F.sequence(F.lit(0), F.size("w"))).alias("i"))

    def blocks(df: DataFrame, size: int) -> list[DataFrame]:
        df, n = df.filter(F.col("size") == size), -(-counts[size] // WINDOW_BLOCK)
        return [df.filter(F.pmod(F.xxhash64("wid"), F.lit(n)) == b) for b in range(n)]

    found: list[DataFrame] = []
    for size in sorted(counts):
        for block in blocks(wins, size):
            shingles = block.select("wid", F.explode(F.sequence(F.lit(0), F.col("k") - size)).alias("off"), "win").withColumn("key", _key("win", F.col("off"), size)).drop("win")
            df = (
                places.select(_key("w", F.col("i"), size).alias("key"))
                .join(F.broadcast(shingles.select("key").distinct()), "key").groupBy("key").agg(F.count("*").alias("df"))
            )
            first = shingles.join(df, "key", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("df", F.lit(0)), "key", "off")).alias("p"))
            prefix = stored(block.join(first, "wid").select(F.col("p.key").alias("key"), F.col("p.off").alias("off"), "win", "k", "wid"), "prefixes")
            found.append(_matches(places, prefix, size, not found))
    if not found:
        empty = wins.select(F.lit(1).cast("long").alias("key"), F.lit(0).alias("off"), "win", "k", "wid")
        found.append(_matches(places, empty, 1, True))
    # Repeated rows of one id and text give one group; its rows are counted by their ends.
    rows = stored(reduce(DataFrame.unionByName, found).groupBy(*DOC, "start", "end", "wid").agg(F.max("n").alias("n"), F.count("*").alias("times")), "hits")
    before = F.max("end").over(Window.partitionBy(*DOC).orderBy(F.col("start").asc_nulls_first(), F.col("end")).rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))), F.lit(0))
    ended = F.col("wid").isNull()
    per = rows.withColumn("fresh", fresh).groupBy(*DOC).agg(F.max("n").alias("n_words"), F.max(F.when(ended, F.col("times"))).alias("times"), F.coalesce(F.sum("fresh"), F.lit(0)).alias("n_hit"))
    held = rows.filter(~ended).select(*DOC, "wid").distinct().join(pairs.select("wid", "item"), "wid")
    held = held.groupBy(*DOC).agg(F.array_sort(F.collect_set("item")).alias("held")).toDF(*(f"held_{c}" for c in DOC), "held")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"held_{c}")) for c in DOC))
    named_items = F.coalesce("held", F.array().cast("array<string>"))
    out = per.join(held, same, "left").select(*DOC, "n_words", "n_hit", named_items.alias("items"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy"))
    return out.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items", *DOC[1:],
    )


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose text holds a window of an item; all its columns, whatever their names."""
    hit = contamination(docs, items, id_col, text_col, **options).filter("contaminated").select(*DOC).distinct()
    # Columns of ``docs`` under names of ours, so that none can clash.
    own = docs.select(*(named(c).alias(f"own_{i}") for i, c in enumerate(docs.columns)))
    place = {c: f"own_{i}" for i, c in enumerate(docs.columns)}
    keys = _doc(place[id_col], place[text_col])
    kept = own.withColumns({f"key_{i}": k for i, k in enumerate(keys)})
    kept = kept.join(hit, reduce(lambda a, b: a & b, (F.col(f"key_{i}").eqNullSafe(F.col(c)) for i, c in enumerate(DOC))), "left_anti")
    return kept.select(*(F.col(place[c]).alias(c) for c in docs.columns))
