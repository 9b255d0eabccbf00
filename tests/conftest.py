import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from farsight import tune  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("farsight-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()


@pytest.fixture()
def one(spark):
    """Evaluates column expressions over one row of string columns."""

    def run(*columns, **values):
        names = list(values) or ["_"]
        schema = ", ".join(f"{n} string" for n in names)
        row = tuple(values.get(n) for n in names)
        out = spark.createDataFrame([row], schema).select(*columns).head()
        return out[0] if len(out) == 1 else tuple(out)

    return run
