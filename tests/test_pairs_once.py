"""Pairs of a group made once, and units of bits found without a lambda."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as contract
from ecoframe.operators import skew
from ecoframe.session import materialise
from tests.conftest import SF


def test_every_pair_once_and_in_order(spark):
    rows = [(k, f"{k}{n * 37 % 101}", n) for k, size in (("a", 41), ("b", 7), ("c", 1)) for n in range(size)] + [(None, "x", 0), (None, "y", 1), ("a", None, 5)]
    df = materialise(spark.createDataFrame(rows, "k string, site string, v int"))
    got = skew.blocked_pairs(df, ["k"], "site", 100, 6)
    want = [(k, s, t, v, w) for k, s, v in rows for j, t, w in rows if k and k == j and s and t and s < t]
    assert sorted(tuple(r) for r in got.select("k", "site_1", "site_2", "v_1", "v_2").collect()) == sorted(want)
    # Cells of two blocks are made once: of 41 rows in 7 blocks 28 cells, not 49.
    assert got.rdd.getNumPartitions() == 9  # (41 * 41 + 7 * 7 + 1) / 2 pairs by hundreds


def test_delta_predictions_do_not_make_both_orders(spark):
    plan = contract.queries()["delta_predictions"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "__high" in plan and "__cell_left" not in plan


def test_shared_units_without_a_lambda(spark):
    plan = contract.queries()["shared_taxa"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "inline" in plan and not re.search(r"lambda", plan)
