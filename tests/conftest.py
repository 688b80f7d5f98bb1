from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from sparrowline import prepare


def make_session() -> SparkSession:
    session = (
        SparkSession.builder.master("local[8]")
        .appName("sparrowline-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return prepare(session)


@pytest.fixture(scope="session")
def spark():
    session = make_session()
    yield session
    session.stop()
