"""Tables between jobs, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def named(column: str) -> Column:
    """A column by its whole name, whatever characters that holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where that isn't set, a local session gets a folder of its own; on a cluster, whose
    machines would each write to their own disks, this raises.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="rosterlens-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/rosterlens/{name}-{uuid.uuid4().hex}"


#: Tables of blocks that this process has made.
_tables: list[str] = []


def made_table(name: str) -> str:
    _tables.append(name)
    return name


def clear(spark: SparkSession) -> None:
    """Drop the intermediate tables and files of all operators; call it once their results are written."""
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/rosterlens")
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
