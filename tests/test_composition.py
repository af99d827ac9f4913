"""Packed taxa of site pairs against plain loops."""

import random

import numpy as np
import pyarrow as pa
import pytest

from ecoframe.operators import composition, diversity, joins

SCHEMA = "SS string, SSBS string, Family string, Taxon_name_entered string, Measurement double, Predominant_land_use string, Use_intensity string"


def inventory(seed, sites=14, taxa=12):
    rng = random.Random(seed)
    rows = []
    for study in ("a", "b"):
        for s in range(sites):
            use = "Minimal use" if s % 3 == 0 else "Light use"
            for _ in range(rng.randrange(1, 30)):
                t = rng.randrange(taxa)
                taxon = None if rng.random() < 0.05 else f"T{t}"
                value = rng.choice([0.0, None, 1.0, 1.0, 2.5, float(rng.randrange(9))])
                rows.append((study, f"{study}{s}", None if t == 0 else f"F{t % 4}", taxon, value, "Primary vegetation", use))
    rows.append(("b", "b-empty", "F1", None, None, "Primary vegetation", "Light use"))
    return rows + rows[:7]


def plain(rows, by_family):
    """{(first, other, unit): score} of all reference pairs."""
    refs = {r[1] for r in rows if r[6] == "Minimal use"}
    sites = {r[1]: r[0] for r in rows}
    out = {}
    for p in refs:
        for o in sites:
            if p == o or sites[p] != sites[o] or (o in refs and p > o):
                continue
            for unit in {r[2] for r in rows if r[2]} if by_family else {None}:
                mine, theirs = ([r for r in rows if r[1] == s and (not by_family or r[2] == unit)] for s in (p, o))
                if not mine or not theirs:
                    continue
                a, b = (sum(r[4] or 0 for r in x) for x in (mine, theirs))
                both = sum(min(x[4] or 0, y[4] or 0) for x in mine for y in theirs if x[3] is not None and x[3] == y[3])
                out[p, o, unit] = None if a == b == 0 else 2 * both / (a + b) if a and b else 0.0
    return out


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("by_family", [False, True])
def test_scores_of_all_pairs(spark, monkeypatch, small, by_family):
    if small:  # several cells per study, sites in parts, dictionaries in buckets, units in words
        for name, value in {"CELL_SITES": 3, "CELL_NODES": 7, "CELL_ENTRIES": 20, "PART_ENTRIES": 4, "BUCKET": 3, "WORD": 2}.items():
            monkeypatch.setattr(composition, name, value)
    rows = inventory(3 + by_family)
    obs = spark.createDataFrame(rows, SCHEMA)
    pairs = joins.site_pairs_with_reference(obs)
    found = diversity.bray_curtis_by_taxon(pairs, obs, ["Family"]) if by_family else diversity.bray_curtis(pairs, obs)
    got = [(r.Primary_minimal_site, r.Other_site, r.Family if by_family else None, r.Bray_Curtis_score) for r in found.collect()]
    want = plain(rows, by_family)
    assert len(got) == len(want) and {g[:3] for g in got} == set(want)
    for *pair, score in got:
        assert score == (None if want[tuple(pair)] is None else pytest.approx(want[tuple(pair)]))
    if by_family:
        shared = [tuple(r) for r in joins.shared_taxa(pairs, obs, ["Family"]).select("Primary_minimal_site", "Other_site", "Family").collect()]
        assert sorted(shared) == sorted(want)
    empty = diversity.bray_curtis(pairs.limit(0), obs)
    assert empty.count() == 0 and diversity.bray_curtis(pairs, obs.limit(0)).count() == 0


def test_long_lists_of_values():
    """One taxon with very many values at a site: running sums, not all pairs of values."""
    rng = np.random.default_rng(0)

    def entries(sizes):
        lists = [[(int(c), float(v), int(w)) for c, n in site for v, w in zip(rng.random(n), rng.integers(1, 4, n))] for site in sizes]
        columns = [[[e[k] for e in site] for site in lists] for k in range(3)]
        types = [pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.int64())]
        table = pa.table([*[pa.chunked_array([pa.array(c, t)]) for c, t in zip(columns, types)], pa.array([1.0] * len(lists))], names=["__codes", "__v", "__w", "__sum"])
        return composition._Entries(table), lists

    a, plain_a = entries([[(5, 3), (900, 40)], [(7, 1)], []])
    b, plain_b = entries([[(5, 20), (900, 2)], [(5, 8), (7, 9), (11, 1)]])
    i, j = np.repeat(np.arange(3), 2), np.tile(np.arange(2), 3)
    want = [sum(x[2] * y[2] * min(x[1], y[1]) for x in plain_a[p] for y in plain_b[q] if x[0] == y[0]) for p, q in zip(i, j)]
    assert np.allclose(composition._lesser_sums(a, b, i, j), want)
    big_a, _ = entries([[(1, 100_000)]])
    big_b, _ = entries([[(1, 100_000)]])
    assert composition._lesser_sums(big_a, big_b, np.zeros(1, np.int64), np.zeros(1, np.int64))[0] > 0


def test_no_row_per_shared_taxon(spark):
    """Pairs meet packed sites: no taxon is left in the plan that follows the packing."""
    obs = spark.createDataFrame(inventory(1), SCHEMA)
    pairs = joins.site_pairs_with_reference(obs)
    plan = diversity.bray_curtis(pairs, obs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Taxon_name_entered" not in plan
