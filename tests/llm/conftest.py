import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def docs(spark):
    """Null and empty texts, ties, repeated rows and columns whose names clash with results."""
    long = "the quick brown fox jumps over a lazy dog while many other words follow " * 400
    rows = [(1, "Hello there. Write to me at a.b@mail.example.com or call +1 (555) 555-0100."), (2, None), (3, ""), (4, "   \n\t "), (5, long), (5, long), (6, long + "end"), (None, "no id here"), (None, None)]
    return spark.createDataFrame([(i, t, "x", j) for j, (i, t) in enumerate(rows)], "doc_id long, text string, shard string, bucket int")
