import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from namesieve.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate column expressions over one row of named values."""

    def run(column, **values):
        from pyspark.sql.types import StringType, StructField, StructType

        if not values:
            return spark.range(1).select(column).first()[0]
        if all(v is None or isinstance(v, str) for v in values.values()):
            schema = StructType([StructField(k, StringType()) for k in values])
            df = spark.createDataFrame([tuple(values.values())], schema)
        else:
            df = spark.createDataFrame([tuple(values.values())], list(values))
        return df.select(column).first()[0]

    return run
