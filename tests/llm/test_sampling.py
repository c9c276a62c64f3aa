"""Bounded samples: never more rows than asked for, the same for the same rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tonelake.llm.sampling import bounded_sample


@pytest.mark.parametrize("most", [1, 50, 400, 5000])
def test_bound_and_repeatability(spark, most):
    rows = spark.range(3000).withColumn("label", F.col("id") % 2)
    first = {r["id"] for r in bounded_sample(rows, F.col("id").cast("string"), most).collect()}
    again = {r["id"] for r in bounded_sample(rows.repartition(7), F.col("id").cast("string"), most).collect()}
    assert first == again and len(first) == min(most, 3000)
    if most == 400:
        assert 120 < sum(k % 2 for k in first) < 280


def test_empty(spark):
    assert bounded_sample(spark.range(0), F.col("id").cast("string"), 10).count() == 0
