"""Scope of pairs: the table of all pairs is written once, by whoever made it, and never shuffled."""

import random

from ecoframe.operators import ranking, scope
from ecoframe.session import materialise
from tests.test_pairs import everything


def pairs_of(spark):
    """A pair once per study; site s3 and two references are in both studies, one of them with an outlier."""
    r = random.Random(3)
    rows = []
    for study in ("A", "B"):
        for p in ("p1", "p2", f"{study}9"):
            for n in range(12):
                site = "s3" if n == 3 else f"{study}{n}"
                score = 5.0 if (n == 3 and study == "A") or n == 7 else r.random()
                rows.append((study, site, p, "Cropland" if n % 5 else "Cannot decide", None if n == 8 else score, float(n)))
    return materialise(spark.createDataFrame(rows, "SS string, SSBS string, Primary_minimal_site string, Predominant_land_use string, y double, x double"))


def test_scope_of_pairs_without_writing_them_again(spark, monkeypatch):
    pairs = pairs_of(spark)
    plain = {"diversity_type": "beta", "response": "y", "checked_columns": ["x"], "require_intensity": False, "fraction": 0.9, "k_min": 9, "k_max": 400, "iqr_multiplier": 0.5}
    want = scope.model_scope(pairs, None, scope.ScopeSettings(**plain)).collect()
    written = []
    monkeypatch.setattr(scope, "materialise", lambda df, label="stage": written.append((label, materialise(df, label))) or written[-1][1])
    got = scope.model_scope(pairs, None, scope.ScopeSettings(**plain, pairs_once=True)).collect()
    assert want and sorted(map(repr, want)) == sorted(map(repr, got))
    assert [n for n, _ in written].count("scope") == 1  # the sample
    # A pair of both studies stays for its other row.
    assert any(r.SSBS == "s3" and r.y == 5.0 for r in scope.filter_outlier_pairs(pairs, "y", 0.5, ["SSBS", "Primary_minimal_site"]).collect())


def test_outliers_of_pairs_as_of_any_rows(spark):
    pairs, keys = pairs_of(spark), ["SSBS", "Primary_minimal_site"]
    for m in (0.0, 0.5, 3.0):
        assert everything(scope.filter_outlier_pairs(pairs, "y", m, keys)) == everything(scope.filter_outliers_iqr(pairs, "y", m, keys))


def test_quantiles_of_few_keys(spark):
    r = random.Random(1)
    values = [("a", r.gauss(0, 1)) for _ in range(500)] + [("b", 1.0)] * 7 + [("c", x) for x in (-1.7e308, 0.0, 1.7e308, float("nan"), float("inf"), None)]
    values += [(None, float(x)) for x in (3, 1, 2)] + [("d", 0.1 * (x % 3)) for x in range(100)] + [("e", None)]
    df = materialise(spark.createDataFrame(values, "k string, v double"))
    probs = {"q1": 0.25, "q2": 0.5, "q3": 0.75, "top": 1.0}
    assert everything(ranking.quantiles_of_few_keys(df, ["k"], "v", probs)) == everything(ranking.quantiles(df, ["k"], "v", probs))
