import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def h1(spark):
    rows = [
        (1, 1, 0.9, "A"),
        (1, 1, 0.8, "A"),
        (0, 1, 0.7, "A"),
        (0, 0, 0.2, "A"),
        (1, 0, 0.4, "B"),
        (1, 1, 0.6, "B"),
        (0, 0, 0.4, "B"),
        (0, 0, 0.1, None),
    ]
    return spark.createDataFrame(rows, "y int, p int, s double, g string")


@pytest.fixture(scope="session")
def h2(spark):
    return spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0), (4.0, 8.0)], "y double, p double")


def metrics(df):
    """Tall metrics as {(attribute, metric): value}."""
    return {(r["attribute"], r["metric"]): r["value"] for r in df.collect()}
