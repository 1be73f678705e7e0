import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("resight-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def sightings(spark):
    """Hand-made sightings with the edges of the season filter."""
    rows = [
        (1, "A", "4/1/1990", "lay", 150.0),
        (2, "A", "4/11/1990", "Relocate", 150.8),
        (3, "A", "4/21/1990", "in situ", 151.5),
        (4, "A", "4/1/1992", "probable lay", 151.0),
        (5, "A", "4/12/1992", "lay", 152.0),
        (6, "B", "5/1/1990", "lay", None),
        (7, "B", "5/10/1990", "lay", 149.0),
        (8, "C", "6/5/85", " Lay\t", 155.0),
        (9, "D", "6/6/1990", "false crawl", 150.0),
        (10, "E", "13/45/1990", "lay", 150.0),
        (11, "F", "7/1/1990", None, 150.0),
    ]
    return spark.createDataFrame(rows, "event_id long, id string, dt string, result string, size double")
