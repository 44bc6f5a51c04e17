import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from brute import HARD  # noqa: E402


@pytest.fixture
def hard(spark):
    """With columns whose names operators use within."""
    rows = [(i, t, "en", s, len(t or ""), "n", 1, 2) for i, t, s in HARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n string, size int, key int")


@pytest.fixture
def rest(spark, hard):
    """The same with a null id and a repeated row."""
    from pyspark.sql import functions as F

    return hard.unionByName(hard.where("doc_id = 9")).unionByName(hard.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
