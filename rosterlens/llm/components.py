"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: Edges from which on the sides of joins are stored, so that a node with very many edges is split.
LARGE = 2_000_000


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """``(node, root)`` for each node of ``edges(u, v)``; the root is the component's least node.

    Large-star links each node's larger neighbours to its least one, small-star its smaller
    neighbours; both keep the components and flatten them to stars in a logarithmic number of
    rounds. Least neighbours are reduced before they are dealt. A node with very many edges is
    otherwise only a join key: for many edges the joins' sides are stored first, which makes
    them plain shuffles that adaptive execution splits.
    """
    edges = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    before, n = None, edges.count()
    while True:
        keep = stored if n > LARGE else lambda df, _: df
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = keep(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large")
        least = keep(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        edges = stored(small, name)
        s = edges.agg(F.count("*").alias("n"), F.count_distinct("u").alias("d"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        n = s["n"]
        if (now := (n, s["d"], s["h"])) == before or n == 0:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
