import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(cores=4, shuffle_partitions=4, memory="4g")


@pytest.fixture
def one(spark):
    """Evaluate a column expression over one row of named values."""

    def run(expr, **values):
        from pyspark.sql import functions as F

        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("_")])
        return row.select(expr.alias("v")).first().v

    return run
