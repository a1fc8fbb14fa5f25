import random

import pytest


@pytest.fixture
def rng():
    return random.Random(20240)


@pytest.fixture(scope="session")
def table(spark):
    """Documents with extra and clashing columns around the ones that operators read."""

    def make(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        return df.selectExpr("doc_id", "text", "'en' AS lang", "cast(null AS string) AS source", "cast(length(text) AS bigint) AS n_chars", "1 AS n", "2 AS key", "3 AS row", "4 AS dk", "5 AS hash")

    return make
