"""Rounding of results: as Spark's round, without its way by a decimal text."""

import pytest
from pyspark.sql import functions as F

from registry.base import nudge, rounded


@pytest.mark.parametrize("digits", [3, 5, 6])
def test_rounded_as_round(spark, digits):
    step = 10.0 ** -digits
    values = [(s * (k + h) * step,) for k in (0, 1, 7, 12344, 99999) for h in (0.0, 0.25, 0.5, 0.75) for s in (1, -1)]
    values += [(x,) for x in (None, 0.0, -0.0, 1e-300, 123.4565005, 999.9999995, 1e7 + 0.5 * step, -1e15, 1e300, float("inf"), float("-inf"), float("nan"))]
    df = spark.createDataFrame(values, "x double").withColumn("label", F.lit("a"))
    want = df.selectExpr(f"round(x + {nudge(digits)}, {digits}) + 0e0 AS x", "label")
    assert list(map(repr, rounded(df, digits).collect())) == list(map(repr, want.collect()))


def test_usual_values_are_counted_in_steps(spark):
    plan = rounded(spark.range(3).selectExpr("id / 7 AS x"), 6)._jdf.queryExecution().optimizedPlan().toString()
    assert "rint" in plan.lower()
