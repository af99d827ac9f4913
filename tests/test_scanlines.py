"""Zonal means by runs and running sums against a test of every pixel; levels in one pass."""

import random

import pytest
from pyspark.sql import functions as F

import fixtures
from ecoframe import config
from ecoframe.operators import diversity, geo
from tests.conftest import SF


@pytest.mark.parametrize("origin, cell", [((0.0, 0.0), (1.0, 1.0)), ((-7.0, 41.0), (0.5, -0.25))])
@pytest.mark.parametrize("all_touched", [True, False])
def test_zonal_means_pixel_by_pixel(spark, origin, cell, all_touched):
    rng = random.Random(7)
    grid = [("r", ix, iy, float(rng.randrange(1000))) for ix in range(-3, 1100) for iy in (0, 1, 2, 5) if rng.random() < 0.8]
    grid += [g for g in grid[:50]] + [("q", 4, 1, 9.0), ("r", 5, 1, float("nan")), ("r", 6, 1, None), ("other", 5, 1, 3.0)]
    pixels = spark.createDataFrame(grid, "raster_id string, ix int, iy int, value double")
    rows = []
    for i in range(30):
        wide = rng.choice([0.4, 1.0, 3.0, 260.0])
        rows.append((f"p{i}", origin[0] + cell[0] * rng.choice([rng.uniform(-2, 1000), rng.randrange(0, 900)]), origin[1] + cell[1] * rng.uniform(0, 4), wide * abs(cell[0])))
    sites = spark.createDataFrame(rows, "k string, x double, y double, r double")
    for shape in ("round", "square"):
        polygons = sites.withColumn("polygon", geo.buffer_polygon(F.col("x"), F.col("y"), F.col("r"), shape))
        found = {r.k: (r.r, r.q) for r in geo.zonal_stats(polygons.select("k", "polygon"), pixels, ["k"], ["r", "q"], origin, cell, all_touched).collect()}
        other = {r.k: r.r for r in geo.zonal_stats(polygons.select("k", "polygon"), pixels, ["k"], ["r"], origin, cell, all_touched, metric=F.max).collect()}
        assert len(found) == len(other) == 30
        w, h = abs(cell[0]), abs(cell[1])
        for p in polygons.select("k", "polygon", geo.edges(F.col("polygon")).alias("e")).collect():
            values = {"r": [], "q": []}
            xs, ys = [c.x for c in p.polygon], [c.y for c in p.polygon]
            for name, ix, iy, value in grid:
                cx, cy = origin[0] + (ix + 0.5) * cell[0], origin[1] + (iy + 0.5) * cell[1]
                if name not in values or value is None or value != value:
                    continue
                if all_touched:
                    boxed = cx + w / 2 > min(xs) and cx - w / 2 < max(xs) and cy + h / 2 > min(ys) and cy - h / 2 < max(ys)
                    inside = boxed and all(e.nx * cx + e.ny * cy - e.c + abs(e.nx) * w / 2 + abs(e.ny) * h / 2 > 0 for e in p.e)
                else:
                    inside = all(e.nx * cx + e.ny * cy - e.c >= 0 for e in p.e)
                if inside:
                    values[name].append(value)
            expected = tuple(sum(v) / len(v) if v else None for v in values.values())
            assert found[p.k] == tuple(e if e is None else pytest.approx(e) for e in expected)
            assert other[p.k] == max(values["r"], default=None)


def test_polygons_without_area_or_pixels(spark):
    sites = spark.createDataFrame([("a", 0.5, 0.5, 1.0)], "k string, x double, y double, r double")
    pixels = spark.createDataFrame([("r", 90, 90, 1.0)], "raster_id string, ix int, iy int, value double")
    for shape in ("flat", "round"):
        polygons = sites.withColumn("polygon", geo.buffer_polygon(F.col("x"), F.col("y"), F.col("r"), shape))
        assert geo.zonal_stats(polygons.select("k", "polygon"), pixels, ["k"], ["r"]).collect() == [("a", None)]


def test_levels_at_once_equal_single_levels(spark):
    path = ["Kingdom", "Phylum", "Class"]
    obs = fixtures.view(spark, SF, "site_obs").select(
        *config.SITE_KEYS, "Biome", "Diversity_metric_type", "Taxon_name_entered", "Measurement", "Effort_corrected_measurement", *path
    )
    every = diversity.alpha_diversity_levels(obs, [0, 1, 2, 3], ["Taxon_name_entered"], path)
    # Observations are expanded once, after they are aggregated.
    plan = every._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand [") == 2  # one branch for the values, one for the study maxima
    every = every.cache()
    for level in range(4):
        single = diversity.alpha_diversity(obs, level, ["Taxon_name_entered"], path)
        keys = [*config.SITE_KEYS, *path[:level]]
        both = every.where(F.col("level") == level)
        assert both.count() == single.count()

        def plain(df):
            values = [c for c in df.columns if c in diversity.ALPHA_METRICS or c.startswith(("Scaled_", "Study_max_"))]
            return sorted((tuple(str(r[k]) for k in keys), tuple(None if r[v] is None else round(r[v], 6) + 0.0 for v in sorted(values))) for r in df.collect())

        assert plain(both) == plain(single)
