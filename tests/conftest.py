import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from rosterlens.session import local_session

    session = local_session(4, shuffle_partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def value(spark):
    """The value of a column expression over one row of named inputs."""

    def get(make, **inputs):
        from pyspark.sql import functions as F

        df = spark.range(1)
        for name, v in inputs.items():
            df = df.withColumn(name, F.lit(None).cast("string") if v is None else F.lit(v))
        return df.select(make(*(F.col(n) for n in inputs)).alias("v")).first()["v"]

    return get
