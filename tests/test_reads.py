"""How often a query reads the largest table, and what it writes on the way."""

import re
import sys

import pytest

import __spark_entry__ as contract
from ecoframe import session
from tests.conftest import SF


def plans(spark, monkeypatch, name):
    """Optimised plans of the tables that a query writes (by label), and of its result."""
    seen, plain = [], session.materialise

    def note(df, label):
        seen.append((label, df._jdf.queryExecution().optimizedPlan().toString()))

    def noted(df, label="stage"):
        note(df, label)
        return plain(df, label)

    for module in list(sys.modules.values()):
        if getattr(module, "materialise", None) is plain:
            monkeypatch.setattr(module, "materialise", noted)
    note(contract.queries()[name](spark, SF), "result")
    return seen


@pytest.mark.parametrize(
    "name, reads",
    [("model_scope", 1), ("alpha_diversity_levels", 1), ("check_concat", 2), ("intactness_runs", 1), ("cv_summary", 1), ("rollup_mapping", 1), ("model_index_columns", 1)],
)
def test_lineitem_is_read_once(spark, monkeypatch, name, reads):
    found = plans(spark, monkeypatch, name)
    assert sum(len(re.findall(r"Relation \[l_orderkey#\d+L?,l_partkey", p)) for _, p in found) == reads


def test_labels_follow_from_few_rows(spark, monkeypatch):
    assert [label for label, _ in plans(spark, monkeypatch, "hierarchy_labels")] == ["result"]
    written = dict(plans(spark, monkeypatch, "rollup_mapping"))
    assert "SSBS" not in written["combos"].splitlines()[0]


def test_index_columns_take_sites_once(spark, monkeypatch):
    found = plans(spark, monkeypatch, "model_index_columns")
    assert [label for label, _ in found].count("sites") == 1


def test_calibration_writes_the_means_first(spark, monkeypatch):
    (label, means), (_, result) = plans(spark, monkeypatch, "calibration_by_group_runs")
    assert label == "runs" and "Aggregate" in means and "l_orderkey" not in result


def test_random_neighbours_are_drawn_under_a_limit(spark, monkeypatch):
    found = plans(spark, monkeypatch, "gower_per_group_random")
    assert "WindowGroupLimit" in dict(found)["distances"]
    assert found[0][0] == "distances"
