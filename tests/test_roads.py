"""Unions of road stretches and quadtree covers against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ecoframe.operators import geo, roads

SEGMENT = "epsg_code int, x1 double, y1 double, x2 double, y2 double"


def total(df):
    length = F.sqrt(F.pow(F.col("x2") - F.col("x1"), F.lit(2)) + F.pow(F.col("y2") - F.col("y1"), F.lit(2)))
    return df.agg(F.sum(length)).first()[0]


@pytest.mark.parametrize("stretch", [7.0, 1e6])
def test_union_of_collinear_segments(spark, stretch):
    """Random intervals on a few lines of several directions, either way round, with repeats."""
    rng = random.Random(2)
    rows, covered = [], {}
    for line, (ux, uy, x0, y0) in enumerate([(1, 0, 3, 4), (0, 1, -5, 2), (3, 4, 0.5, 0.25), (3, -4, 0.5, 0.25), (1, 1000, 0, 0), (3, 4, 0.5, 0.251)]):
        marks = covered.setdefault(line, set())
        for _ in range(60):
            a = rng.randrange(-40, 40)
            b = a + rng.randrange(1, 6)
            ends = (x0 + ux * a / 8, y0 + uy * a / 8), (x0 + ux * b / 8, y0 + uy * b / 8)
            if rng.random() < 0.5:
                ends = ends[::-1]
            rows.append((1, *ends[0], *ends[1]))
            marks |= set(range(a, b))
        covered[line] = len(marks) / 8 * math.hypot(ux, uy)
    rows += rows[:40] + [(1, 2.0, 2.0, 2.0, 2.0), (1, math.nan, 0.0, 1.0, 1.0), (1, None, 0.0, 1.0, 1.0), (2, *rows[0][1:])]
    united = roads.union_segments(spark.createDataFrame(rows, SEGMENT), ["epsg_code"], stretch_m=stretch).cache()
    assert total(united.where("epsg_code = 1")) == pytest.approx(sum(covered.values()), abs=1e-6)
    assert total(united.where("epsg_code = 2")) == pytest.approx(math.dist(rows[0][1:3], rows[0][3:5]), abs=1e-9)
    assert roads.union_segments(spark.createDataFrame([], SEGMENT), ["epsg_code"]).count() == 0


def test_pieces_lie_in_one_cell(spark):
    rng = random.Random(3)
    rows = [(1, *(rng.uniform(-30, 30) for _ in range(4))) for _ in range(50)] + [(1, 0.0, -12.0, 0.0, 12.0), (1, -9.0, 10.0, 9.0, 10.0), (1, 5.0, 5.0, 15.0, 15.0)]
    frame = spark.createDataFrame(rows, SEGMENT)
    pieces = roads.cell_pieces(frame, ["epsg_code"], 5.0).collect()
    for p in pieces:
        assert p.cx * 5 - 1e-9 <= min(p.x1, p.x2) and max(p.x1, p.x2) <= p.cx * 5 + 5 + 1e-9
        assert p.cy * 5 - 1e-9 <= min(p.y1, p.y2) and max(p.y1, p.y2) <= p.cy * 5 + 5 + 1e-9
    assert sum(p.length for p in pieces) == pytest.approx(total(frame))


def test_cover_parts_the_polygon(spark):
    """Sample points: in at most one cell, in one if in the polygon, in the polygon if the cell is inside."""
    rng = np.random.default_rng(4)
    sites = spark.createDataFrame([(f"s{i}", *map(float, rng.uniform(-5000, 5000, 2)), r) for i in range(3) for r in (1, 3)], "SSBS string, easting double, northing double, radius_km int")
    for shape in ("round", "square"):
        polygons = sites.withColumn("polygon", geo.buffer_polygon(F.col("easting"), F.col("northing"), F.col("radius_km") * 1000.0, shape))
        sides = polygons.select("SSBS", "radius_km", "easting", "northing", geo.edges(F.col("polygon")).alias("e")).collect()
        cover = {}
        for c in roads.quad_cover(polygons, ["SSBS", "radius_km"], 125.0, 3).collect():
            cover.setdefault((c.SSBS, c.radius_km), []).append(c)
        for p in sides:
            for x, y in rng.uniform(-1.2, 1.2, (300, 2)) * p.radius_km * 1000 + [p.easting, p.northing]:
                within = all(e.nx * x + e.ny * y >= e.c for e in p.e)
                held = [c for c in cover[p.SSBS, p.radius_km] if x // (125 << c.level) == c.cx and y // (125 << c.level) == c.cy]
                assert len(held) <= 1 and (held or not within)
                if held:
                    near = all(e.nx * x + e.ny * y >= e.c for e in held[0].edges)
                    assert near == within and (within or not held[0].inside)
    flat = sites.withColumn("polygon", geo.buffer_polygon(F.col("easting"), F.col("northing"), F.col("radius_km") * 1000.0, "flat"))
    assert roads.quad_cover(flat, ["SSBS"]).count() == 0


def test_density_on_crowded_cells(spark):
    """Very many roads in one cell, overlapping roads, a polygon without roads, and no road at all."""
    lines = [(1, 0.0, 10.0 + i / 100, 400.0, 10.0 + i / 100) for i in range(3000)] + [(1, 100.0, 10.0, 900.0, 10.0)]
    segments = spark.createDataFrame(lines, SEGMENT)
    sites = spark.createDataFrame([("a", 1, 200.0, 0.0), ("b", 1, 90000.0, 0.0), ("c", 2, 200.0, 0.0)], "SSBS string, epsg_code int, easting double, northing double")
    buffers = geo.buffer_sites(sites, [1], "square").select("SSBS", "epsg_code", "polygon")
    got = {r.SSBS: r.Road_density for r in roads.road_density(buffers, segments, ["SSBS"]).collect()}
    assert got == {"a": pytest.approx(3000 * 400 + 500), "b": 0.0, "c": 0.0}
    none = roads.road_density(buffers, segments.limit(0), ["SSBS"]).collect()
    assert {r.SSBS: r.Road_density for r in none} == {"a": 0.0, "b": 0.0, "c": 0.0}
    zoneless = roads.road_density(buffers, segments, ["SSBS"], match_zone=False).collect()
    assert {r.SSBS for r in zoneless if r.Road_density} == {"a", "c"}


def test_candidates_per_true_pair(spark):
    """Rows that meet, counting pieces in cells inside as one pair each, stay under twice the true pairs."""
    rng = np.random.default_rng(6)
    ends = rng.uniform(0, 40_000, (4000, 2))
    segments = spark.createDataFrame([(1, *map(float, a), *map(float, a + d)) for a, d in zip(ends, rng.uniform(-300, 300, (4000, 2)))], SEGMENT)
    sites = spark.createDataFrame([(f"s{i}", 1, *map(float, p)) for i, p in enumerate(rng.uniform(10_000, 30_000, (20, 2)))], "SSBS string, epsg_code int, easting double, northing double")
    polygons = geo.buffer_sites(sites, [1, 5, 10], "round").select("SSBS", "radius_km", "polygon")
    cover = roads.quad_cover(polygons, ["SSBS", "radius_km"])
    pieces = roads.cell_pieces(segments, ["epsg_code"])
    listed = roads._ancestors(pieces, list(range(8)), [F.col(c) for c in ("x1", "y1", "x2", "y2")])
    met = cover.join(listed, ["level", "cx", "cy"]).select((F.col("inside") | (geo.clipped_length("edges") > 0)).cast("int").alias("hit"))
    candidates, true = met.agg(F.count("*"), F.sum("hit")).first()
    assert true <= candidates <= 2 * true


def _round_sites(spark):
    sites = spark.range(12).select(
        F.concat(F.lit("s"), "id").alias("SSBS"), F.lit(32601).alias("epsg_code"),
        (F.col("id") % 3 * 700).cast("double").alias("x"), F.lit(100.0).alias("y"),
    )
    return sites.select("SSBS", "epsg_code", geo.buffer_polygon(F.col("x"), F.col("y"), F.lit(1500.0), "round").alias("polygon"))


def _crossing_roads(spark):
    at = F.col("id").cast("double")
    return spark.range(60).select(F.lit(32601).alias("epsg_code"), (at * 61 - 2000).alias("x1"), (at * 37 - 1500).alias("y1"), (at * 61 - 1300).alias("x2"), (at * 29 - 900).alias("y2"))


def test_equal_polygons_are_covered_once(spark, monkeypatch):
    covered, plain = [], roads.quad_cover
    monkeypatch.setattr(roads, "quad_cover", lambda polygons, *a: covered.append(polygons.count()) or plain(polygons, *a))
    got = {r.SSBS: r.Road_density for r in roads.road_density(_round_sites(spark), _crossing_roads(spark), ["SSBS"]).collect()}
    assert covered == [3] and len(got) == 12 and got["s0"] == got["s9"] > 0 and got["s0"] != got["s1"]


def test_crowded_rim_cells_are_cut_without_a_change(spark, monkeypatch):
    sites, segments = _round_sites(spark), _crossing_roads(spark)
    whole = {r.SSBS: r.Road_density for r in roads.road_density(sites, segments, ["SSBS"]).collect()}
    for name, size in (("RIM_ROWS", 2), ("RIM_PIECES", 3), ("CACHED_PAIRS", 2)):
        monkeypatch.setattr(roads, name, size)
    cut = {r.SSBS: r.Road_density for r in roads.road_density(sites, segments, ["SSBS"]).collect()}
    assert cut == {k: pytest.approx(v, abs=1e-6) for k, v in whole.items()}
    ring = sites.where("SSBS = 's1'").first().polygon
    clipped = segments.withColumn("edges", geo.edges(F.array(*[geo.point(F.lit(p.x), F.lit(p.y)) for p in ring])))
    assert clipped.agg(F.sum(geo.clipped_length("edges"))).first()[0] == pytest.approx(whole["s1"], abs=1e-3)
