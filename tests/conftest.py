import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from taktline.session import local_session

    session = local_session(cores=4, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Values of column expressions over one input row per value."""
    def run(build, values, kind="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, v {kind}")
        from pyspark.sql import functions as F

        return [r.x for r in df.select("i", build(F.col("v")).alias("x")).orderBy("i").collect()]

    return run
