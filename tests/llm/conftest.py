from __future__ import annotations

import pytest
from common import ODD, SCHEMA


@pytest.fixture
def docs(spark):
    """docs(rows, **extra): documents of (doc_id, text[, source]) with columns whose names clash with the operators' own."""

    def make(rows, parts=3):
        from pyspark.sql import functions as F

        rows = [(*r, "s")[:3] for r in rows]
        df = spark.createDataFrame(rows, SCHEMA)
        return df.withColumns({c: F.lit("mine") for c in ("n", "k", "a", "b", "_d", "_g", "size", "taken_", "h", "bucket", "site", "node")}).repartition(parts)

    return make


@pytest.fixture
def odd():
    return list(ODD)
