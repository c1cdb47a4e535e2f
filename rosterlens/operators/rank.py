"""Positions of rows in a total order, without a task that sees them all.

Rows are dealt by ranges of the order and sorted within them; each range's rows are counted, and the
counts added up before a range are its offset. What reaches the driver is one number for each range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.folders import work_folder

#: Rows of one task are numbered by the low bits of Spark's increasing ids, the task by the high ones.
ROW_BITS = 33


def file_order() -> Column:
    """Where a row stands in the files it was read from: path, start of the part read, row within the task.

    Which parts a file is read in changes the numbers but not their order. For text, CSV and JSON
    straight from a reader; the sources of other rows lack the file's columns.
    """
    return F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))


def positions(df: DataFrame, order: Sequence[Column | str], name: str = "position", first: int = 1) -> DataFrame:
    """``df`` with each row's place in a total order, from ``first`` on, written to the shared folder.

    ``order`` must tell all rows apart for places that never change; rows that it leaves tied get places next to each
    other. Nulls sort as the order's columns say. A value in a third of all rows is split by the columns behind it.
    """
    spark = df.sparkSession
    path = work_folder(spark, "positions")
    ranged = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    ranged.withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumns({"__range": F.shiftright("__at", ROW_BITS), "__row": F.col("__at").bitwiseAND((1 << ROW_BITS) - 1)})
    offsets, before = [], first
    for r in rows.groupBy("__range").agg(F.count("*").alias("n")).orderBy("__range").collect():
        offsets.append((r["__range"], before))
        before += r["n"]
    table = spark.createDataFrame(offsets, "__range long, __before long")
    # One row for each range, of which there are as many as shuffle partitions.
    return rows.join(F.broadcast(table), "__range").withColumn(name, F.col("__before") + F.col("__row")).drop("__at", "__range", "__row", "__before")
