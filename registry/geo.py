from __future__ import annotations

import math

from pyspark.sql import functions as F

from ecoframe.operators import geo as g, roads
from registry.base import PARTS, query

_ZONE = "CAST(floor((Longitude + 180) / 6) + 1 AS INT)"


@query("site_points", "SELECT SSBS, UN_region, Longitude, Latitude FROM {site_base} WHERE SSBS IN (SELECT SSBS FROM {site_obs})", "Longitude Latitude")
def _(v):
    return g.site_points(v("site_obs"), ["Taxon_name_entered"], ["UN_region"])


@query(
    "utm_zone",
    f"SELECT SSBS, Longitude, Latitude, {_ZONE} AS utm_zone, CAST(CASE WHEN Latitude < 0 THEN 32700 ELSE 32600 END + {_ZONE} AS INT) AS epsg_code FROM {{site_base}}",
    "Longitude Latitude",
)
def _(v):
    return g.utm_zone(v("site_base").select("SSBS", "Longitude", "Latitude"))


def _sum(values: list[float], term: str) -> str:
    return " + ".join(f"({c!r}::DOUBLE) * " + term.format(j=2 * j) for j, c in enumerate(values, 1))


_K = g._K0 * g._RADIUS


def forward_sql(lon: str, lat: str, epsg: str, source: str, keep: str) -> str:
    """Easting and northing of (lon, lat) columns, step by step."""
    e = repr(g._ECC)
    a = f"SELECT {keep}, {epsg} AS epsg_code, radians({lon} - (({epsg}) % 100 * 6 - 183)) AS lam, tan(radians({lat})) AS tau, sinh({e} * atanh({e} * sin(radians({lat})))) AS sg FROM {source}"
    b = f"SELECT *, tau * sqrt(1 + sg * sg) - sg * sqrt(1 + tau * tau) AS cf FROM ({a}) a1"
    c = f"SELECT *, atan2(cf, cos(lam)) AS xi0, asinh(sin(lam) / sqrt(cf * cf + cos(lam) * cos(lam))) AS eta0 FROM ({b}) b1"
    xi = _sum(g.ALPHA, "sin({j} * xi0) * cosh({j} * eta0)")
    eta = _sum(g.ALPHA, "cos({j} * xi0) * sinh({j} * eta0)")
    return (
        f"SELECT {keep}, epsg_code, 500000e0 + {_K!r} * (eta0 + {eta}) AS easting, "
        f"CASE WHEN epsg_code >= 32700 THEN 10000000e0 ELSE 0e0 END + {_K!r} * (xi0 + {xi}) AS northing FROM ({c}) c1"
    )


def inverse_sql(x: str, y: str, source: str, keep: str) -> str:
    a = f"SELECT {keep}, epsg_code, ({y} - CASE WHEN epsg_code >= 32700 THEN 10000000e0 ELSE 0e0 END) / {_K!r} AS xi, ({x} - 500000e0) / {_K!r} AS eta FROM {source}"
    xi = _sum(g.BETA, "sin({j} * xi) * cosh({j} * eta)")
    eta = _sum(g.BETA, "cos({j} * xi) * sinh({j} * eta)")
    b = f"SELECT *, xi - ({xi}) AS xi0, eta - ({eta}) AS eta0 FROM ({a}) a2"
    c = f"SELECT *, asin(sin(xi0) / cosh(eta0)) AS chi FROM ({b}) b2"
    phi = _sum(g.DELTA, "sin({j} * chi)")
    return (
        f"SELECT {keep}, epsg_code, degrees(atan2(sinh(eta0), cos(xi0))) + (epsg_code % 100 * 6 - 183) AS lon, "
        f"degrees(chi + {phi}) AS lat FROM ({c}) c2"
    )


_EPSG = f"CAST(CASE WHEN Latitude < 0 THEN 32700 ELSE 32600 END + {_ZONE} AS INT)"
PARTS["projected"] = forward_sql("Longitude", "Latitude", _EPSG, "{site_base}", "SSBS, Longitude, Latitude")


@query("project_utm", "SELECT SSBS, epsg_code, easting, northing FROM {projected}", "easting northing", digits=3)
def _(v):
    return g.project_utm(v("site_base").select("SSBS", "Longitude", "Latitude")).select("SSBS", "epsg_code", "easting", "northing")


PARTS["unprojected"] = inverse_sql("easting", "northing", "{projected}", "SSBS")


@query("unproject_utm", "SELECT SSBS, epsg_code, lon AS Longitude, lat AS Latitude FROM {unprojected}", "Longitude Latitude")
def _(v):
    p = g.project_utm(v("site_base").select("SSBS", "Longitude", "Latitude")).select("SSBS", "epsg_code", "easting", "northing")
    return g.unproject_utm(p).select("SSBS", "epsg_code", "Longitude", "Latitude")


_ANGLE = f"(i % 32) * ({2 * math.pi / 32!r}::DOUBLE)"
PARTS["round_ring"] = f"""
    SELECT SSBS, epsg_code, radius_km, CAST(i AS INT) AS corner, easting + radius_km * 1000 * cos({_ANGLE}) AS x, northing + radius_km * 1000 * sin({_ANGLE}) AS y
    FROM {{projected}}, (SELECT unnest([1, 5, 10, 50])::INT AS radius_km) r, range(0, 33) t(i)"""
PARTS["round_lonlat"] = inverse_sql("x", "y", "{round_ring}", "SSBS, radius_km, corner, x, y")


@query("buffer_sites", "SELECT SSBS, radius_km, corner, x, y, lon, lat FROM {round_lonlat}", "x y lon lat", digits=3)
def _(v):
    b = g.buffer_sites(v("site_base").select("SSBS", "Longitude", "Latitude"))
    both = F.arrays_zip("polygon", "polygon_lonlat")
    return b.select("SSBS", "radius_km", F.posexplode(both).alias("corner", "p")).select(
        "SSBS", "radius_km", "corner", "p.polygon.x", "p.polygon.y",
        F.col("p.polygon_lonlat.x").alias("lon"), F.col("p.polygon_lonlat.y").alias("lat"),
    )


def _as_parts(v):
    """Two-part lines from the road segments; every seventh second part is a lone point."""
    s = v("road_segments")
    mid_x, mid_y = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    end = g.point(F.col("x2"), F.col("y2"))
    first = F.array(g.point(F.col("x1"), F.col("y1")), g.point(mid_x, mid_y))
    second = F.when(F.col("segment_id") % 7 == 0, F.array(end)).otherwise(F.array(g.point(mid_x, mid_y), end))
    return s.select("segment_id", "epsg_code", F.array(first, second).alias("parts"))


@query(
    "split_multilines",
    """SELECT segment_id, epsg_code, 0 AS part, x1, y1, (x1 + x2) / 2 AS x2, (y1 + y2) / 2 AS y2 FROM {road_segments}
       UNION ALL SELECT segment_id, epsg_code, 1, (x1 + x2) / 2, (y1 + y2) / 2, x2, y2 FROM {road_segments} WHERE segment_id % 7 <> 0""",
    "x1 y1 x2 y2",
)
def _(v):
    return g.line_segments(g.split_multilines(_as_parts(v)))


# Clipping of a segment to a square, slab by slab, for every site and segment of the zone.
def _slab(axis: str, centre: str) -> tuple[str, str]:
    d, o = f"({axis}2 - {axis}1)", f"{axis}1"
    lo, hi = f"({centre} - r - {o})", f"({centre} + r - {o})"
    enter = f"CASE WHEN {d} = 0 THEN CASE WHEN {lo} > 0 OR {hi} < 0 THEN 2e0 ELSE 0e0 END ELSE least({lo} / {d}, {hi} / {d}) END"
    leave = f"CASE WHEN {d} = 0 THEN 1e0 ELSE greatest({lo} / {d}, {hi} / {d}) END"
    return enter, leave


_ex, _lx = _slab("x", "easting")
_ey, _ly = _slab("y", "northing")


@query(
    "road_density",
    f"""SELECT s.SSBS, s.radius_km, coalesce(sum(len), 0) AS Road_density FROM (SELECT *, CAST(radius_km * 1000 AS DOUBLE) AS r FROM {{road_sites}}, (SELECT unnest([1, 5]) AS radius_km) k) s
        LEFT JOIN LATERAL (SELECT greatest(least(least({_lx}, {_ly}), 1) - greatest(greatest({_ex}, {_ey}), 0), 0) * sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len
          FROM (SELECT DISTINCT epsg_code, x1, y1, x2, y2 FROM {{road_segments}}) t WHERE t.epsg_code = s.epsg_code
            AND greatest(x1, x2) >= easting - r AND least(x1, x2) <= easting + r AND greatest(y1, y2) >= northing - r AND least(y1, y2) <= northing + r) l ON true
        GROUP BY s.SSBS, s.radius_km""",
    "Road_density",
    digits=3,
)
def _(v):
    b = g.buffer_sites(v("road_sites"), [1, 5], "square")
    return roads.road_density(b.select("SSBS", "radius_km", "epsg_code", "polygon"), v("road_segments"), ["SSBS", "radius_km"])


# A round buffer is a regular polygon of 32 corners: 32 half-planes n * (p - centre) <= apothem.
PARTS["planes"] = "SELECT cos(a) AS nx, sin(a) AS ny, cos(pi() / 32) AS ap FROM (SELECT (2 * i + 1) * pi() / 32 AS a FROM range(0, 32) t(i)) q"
_ALONG, _OUT = "(nx * (x2 - x1) + ny * (y2 - y1))", "(ap * r - nx * (x1 - easting) - ny * (y1 - northing))"


@query(
    "road_density_round",
    f"""SELECT k.SSBS, k.radius_km, coalesce(sum(greatest(least(leave, 1) - greatest(enter, 0), 0) * len), 0) AS Road_density
        FROM (SELECT SSBS, radius_km FROM {{road_sites}}, (SELECT unnest([1, 5]) AS radius_km) k) k LEFT JOIN (
          SELECT SSBS, radius_km, x1, y1, x2, y2, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len,
            max(CASE WHEN {_ALONG} < 0 THEN {_OUT} / {_ALONG} WHEN {_ALONG} = 0 AND {_OUT} < 0 THEN 2e0 ELSE 0e0 END) AS enter,
            min(CASE WHEN {_ALONG} > 0 THEN {_OUT} / {_ALONG} ELSE 1e0 END) AS leave
          FROM (SELECT *, CAST(radius_km * 1000 AS DOUBLE) AS r FROM {{road_sites}}, (SELECT unnest([1, 5]) AS radius_km) k) s
          JOIN (SELECT DISTINCT epsg_code, x1, y1, x2, y2 FROM {{road_segments}}) t ON t.epsg_code = s.epsg_code
            AND greatest(x1, x2) >= easting - r AND least(x1, x2) <= easting + r AND greatest(y1, y2) >= northing - r AND least(y1, y2) <= northing + r
          CROSS JOIN {{planes}} GROUP BY SSBS, radius_km, x1, y1, x2, y2) c ON c.SSBS = k.SSBS AND c.radius_km = k.radius_km
        GROUP BY k.SSBS, k.radius_km""",
    "Road_density",
    digits=3,
)
def _(v):
    b = g.buffer_sites(v("road_sites"), [1, 5], "round")
    return roads.road_density(b.select("SSBS", "radius_km", "epsg_code", "polygon"), v("road_segments"), ["SSBS", "radius_km"])


# Roads of which a second one runs over half of the first and on, a third one back over it.
PARTS["overlapping"] = """
    SELECT epsg_code, x1, y1, x2, y2 FROM {road_segments}
    UNION ALL SELECT epsg_code, (x1 + x2) / 2, (y1 + y2) / 2, x2 + (x2 - x1) / 2, y2 + (y2 - y1) / 2 FROM {road_segments} WHERE segment_id % 3 = 0
    UNION ALL SELECT epsg_code, x2 + (x2 - x1), y2 + (y2 - y1), x1 - (x2 - x1) / 4, y1 - (y2 - y1) / 4 FROM {road_segments} WHERE segment_id % 5 = 0"""
# Lines by reduced direction and offset in whole millimetres, then gaps and islands along each.
PARTS["exact_lines"] = """
    SELECT epsg_code, dx // g AS ux, dy // g AS uy, (dx // g)::HUGEINT * y - (dy // g)::HUGEINT * x AS c, t, t + greatest(dx, abs(dy)) AS u FROM (
      SELECT *, gcd(dx, dy) AS g, CASE WHEN dx >= abs(dy) THEN x ELSE least(y, y + dy) END AS t FROM (
        SELECT epsg_code, CASE WHEN turned THEN xb ELSE xa END AS x, CASE WHEN turned THEN yb ELSE ya END AS y,
          CASE WHEN turned THEN xa - xb ELSE xb - xa END AS dx, CASE WHEN turned THEN ya - yb ELSE yb - ya END AS dy FROM (
          SELECT *, xa > xb OR (xa = xb AND ya > yb) AS turned FROM (
            SELECT epsg_code, round(x1 * 1000)::BIGINT AS xa, round(y1 * 1000)::BIGINT AS ya, round(x2 * 1000)::BIGINT AS xb, round(y2 * 1000)::BIGINT AS yb FROM {overlapping}) a) b) d
      WHERE dx <> 0 OR dy <> 0) e"""
PARTS["islands"] = """
    SELECT epsg_code, ux, uy, c, min(t) AS t, max(u) AS u FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY epsg_code, ux, uy, c ORDER BY t, u ROWS UNBOUNDED PRECEDING) AS island FROM (
        SELECT *, CASE WHEN t <= max(u) OVER (PARTITION BY epsg_code, ux, uy, c ORDER BY t, u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {exact_lines}) f) i
    GROUP BY epsg_code, ux, uy, c, island"""
_AT = [f"(CASE WHEN ux >= abs(uy) THEN {m}::DOUBLE ELSE (ux * {m} - c)::DOUBLE / uy END) / 1000 AS x{n}, (CASE WHEN ux >= abs(uy) THEN (c + uy * {m})::DOUBLE / ux ELSE {m}::DOUBLE END) / 1000 AS y{n}" for n, m in ((1, "t"), (2, "u"))]
PARTS["united"] = f"SELECT epsg_code, {', '.join(_AT)} FROM {{islands}}"


def _overlapping(v):
    s, half = v("road_segments"), ((F.col("x2") - F.col("x1")) / 2, (F.col("y2") - F.col("y1")) / 2)
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))

    def road(*ends):
        return [F.col("epsg_code"), *[e.alias(n) for e, n in zip(ends, ("x1", "y1", "x2", "y2"))]]

    on = s.where("segment_id % 3 = 0").select(*road((x1 + x2) / 2, (y1 + y2) / 2, x2 + half[0], y2 + half[1]))
    back = s.where("segment_id % 5 = 0").select(*road(x2 + half[0] * 2, y2 + half[1] * 2, x1 - half[0] / 2, y1 - half[1] / 2))
    return s.select(*road(x1, y1, x2, y2)).unionByName(on).unionByName(back)


@query(
    "union_segments",
    "SELECT epsg_code, ux, uy, sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))) AS length FROM "
    "(SELECT CAST(sign(round(x2 - x1, 3)) AS INT) AS ux, CAST(sign(round(y2 - y1, 3)) AS INT) AS uy, * FROM {united}) q GROUP BY epsg_code, ux, uy",
    "length", digits=3,
)
def _(v):
    u = roads.union_segments(_overlapping(v), ["epsg_code"])
    length = F.sqrt(F.pow(F.col("x2") - F.col("x1"), F.lit(2)) + F.pow(F.col("y2") - F.col("y1"), F.lit(2)))
    signs = [F.signum(F.round(F.col(f"{a}2") - F.col(f"{a}1"), 3)).cast("int").alias(f"u{a}") for a in "xy"]
    return u.select("epsg_code", *signs, length.alias("length")).groupBy("epsg_code", "ux", "uy").agg(F.sum("length").alias("length"))


@query(
    "road_density_overlapping",
    f"""SELECT s.SSBS, s.radius_km, coalesce(sum(len), 0) AS Road_density FROM (SELECT *, CAST(radius_km * 1000 AS DOUBLE) AS r FROM {{road_sites}}, (SELECT unnest([1, 5]) AS radius_km) k) s
        LEFT JOIN LATERAL (SELECT greatest(least(least({_lx}, {_ly}), 1) - greatest(greatest({_ex}, {_ey}), 0), 0) * sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len
          FROM {{united}} t WHERE t.epsg_code = s.epsg_code
            AND greatest(x1, x2) >= easting - r AND least(x1, x2) <= easting + r AND greatest(y1, y2) >= northing - r AND least(y1, y2) <= northing + r) l ON true
        GROUP BY s.SSBS, s.radius_km""",
    "Road_density",
    digits=2,
)
def _(v):
    b = g.buffer_sites(v("road_sites"), [1, 5], "square")
    return roads.road_density(b.select("SSBS", "radius_km", "epsg_code", "polygon"), _overlapping(v), ["SSBS", "radius_km"])


def _degrees(v):
    """Roads near the sites as multi-lines in degrees: one of two lines of two vertices each per site."""
    s = v("site_base").select("Longitude", "Latitude")
    lon, lat = F.col("Longitude"), F.col("Latitude")
    first = F.array(g.point(lon - 0.004, lat - 0.002), g.point(lon + 0.006, lat + 0.003))
    second = F.array(g.point(lon + 0.001, lat + 0.02), g.point(lon + 0.001, lat - 0.03))
    return s.select(F.array(first, second).alias("parts"))


_ENDS = [("Longitude - 4e-3", "Latitude - 2e-3"), ("Longitude + 6e-3", "Latitude + 3e-3"), ("Longitude + 1e-3", "Latitude + 2e-2"), ("Longitude + 1e-3", "Latitude - 3e-2")]
for _i, (_lon, _lat) in enumerate(_ENDS):
    _first = _ENDS[_i - _i % 2]
    _zone_of_first = f"CAST(CASE WHEN {_first[1]} < 0 THEN 32700 ELSE 32600 END + CAST(floor(({_first[0]} + 180) / 6) + 1 AS INT) AS INT)"
    PARTS[f"end_{_i}"] = forward_sql(f"({_lon})", f"({_lat})", _zone_of_first, "{site_base}", "c_custkey, Longitude, Latitude")
PARTS["near_roads"] = " UNION ALL ".join(
    f"SELECT a.epsg_code, a.easting AS x1, a.northing AS y1, b.easting AS x2, b.northing AS y2 FROM {{end_{i}}} a JOIN {{end_{i + 1}}} b ON a.c_custkey = b.c_custkey" for i in (0, 2)
)


@query(
    "project_lines",
    "SELECT epsg_code, x1, y1, x2, y2 FROM {near_roads}",
    "x1 y1 x2 y2", digits=3,
)
def _(v):
    return g.line_segments(g.project_lines(g.split_multilines(_degrees(v)))).select("epsg_code", "x1", "y1", "x2", "y2")


@query(
    "road_density_of_lines",
    f"""SELECT s.SSBS, s.radius_km, coalesce(sum(len), 0) AS Road_density
        FROM (SELECT *, CAST(radius_km * 1000 AS DOUBLE) AS r FROM {{projected}}, (SELECT unnest([1, 5]) AS radius_km) k) s
        LEFT JOIN LATERAL (SELECT greatest(least(least({_lx}, {_ly}), 1) - greatest(greatest({_ex}, {_ey}), 0), 0) * sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len
          FROM (SELECT DISTINCT epsg_code, round(x1 * 1000) / 1000 AS x1, round(y1 * 1000) / 1000 AS y1, round(x2 * 1000) / 1000 AS x2, round(y2 * 1000) / 1000 AS y2 FROM {{near_roads}}) t WHERE t.epsg_code = s.epsg_code
            AND greatest(x1, x2) >= easting - r AND least(x1, x2) <= easting + r AND greatest(y1, y2) >= northing - r AND least(y1, y2) <= northing + r) l ON true
        GROUP BY s.SSBS, s.radius_km""",
    "Road_density",
    digits=1,
)
def _(v):
    return roads.road_density_of_lines(v("site_base").select("SSBS", "Longitude", "Latitude"), _degrees(v), [1, 5], "square")


def _zonal(v, shape: str, all_touched: bool):
    squares = v("squares").repartition(v.spark.sparkContext.defaultParallelism).withColumn("polygon", g.buffer_polygon(F.col("x"), F.col("y"), F.col("radius"), shape))
    return g.zonal_stats(
        squares.select("SSBS", "radius", "polygon"), v("pixels"), ["SSBS", "radius"], ["A", "N", "R"], all_touched=all_touched
    )


def _zonal_sql(test: str) -> str:
    return (
        "SELECT s.SSBS, s.radius, "
        + ", ".join(f"avg(value) FILTER (raster_id = '{r}') AS \"{r}\"" for r in "ANR")
        + f" FROM {{squares}} s LEFT JOIN {{pixels}} p ON {test} GROUP BY s.SSBS, s.radius"
    )


@query("zonal_stats", _zonal_sql("ix + 1 > x - radius AND ix < x + radius AND iy + 1 > y - radius AND iy < y + radius"), "radius A N R", digits=4)
def _(v):
    return _zonal(v, "square", True)


@query(
    "zonal_stats_centres",
    _zonal_sql("ix + 5e-1 >= x - radius AND ix + 5e-1 <= x + radius AND iy + 5e-1 >= y - radius AND iy + 5e-1 <= y + radius"),
    "radius A N R", digits=4,
)
def _(v):
    return _zonal(v, "square", False)


# A pixel meets the polygon unless one of the polygon's sides or of its own keeps them apart.
PARTS["met"] = """
    SELECT SSBS, s.radius, raster_id, value FROM {squares} s JOIN {pixels} p ON ix + 1 > x - radius AND ix < x + radius AND iy + 1 > y - radius AND iy < y + radius
    CROSS JOIN {planes} GROUP BY SSBS, s.radius, raster_id, ix, iy, value
    HAVING bool_and((CASE WHEN nx > 0 THEN ix ELSE ix + 1 END - x) * nx + (CASE WHEN ny > 0 THEN iy ELSE iy + 1 END - y) * ny < ap * radius)"""


@query(
    "zonal_stats_round",
    "SELECT s.SSBS, s.radius, "
    + ", ".join(f"avg(value) FILTER (raster_id = '{r}') AS \"{r}\"" for r in "ANR")
    + " FROM {squares} s LEFT JOIN {met} m ON m.SSBS = s.SSBS AND m.radius = s.radius GROUP BY s.SSBS, s.radius",
    "radius A N R", digits=4,
)
def _(v):
    return _zonal(v, "round", True)


_CELL_STATS = """avg(Observed) AS Observed_mean, avg(Predicted) AS Predicted_mean, count(*) AS Site_count, count(DISTINCT SS) AS Study_count,
    avg(Predicted - Observed) AS Residual_mean, count(*) FILTER (Predicted > Observed) AS n_overbiased, count(*) FILTER (Predicted < Observed) AS n_underbiased,
    count(*) FILTER (Predicted > Observed) / count(*) AS perc_overbiased, count(*) FILTER (Predicted < Observed) / count(*) AS perc_underbiased"""
_CELL_DOUBLES = ["res_km", "Observed_mean", "Predicted_mean", "Residual_mean", "perc_overbiased", "perc_underbiased", "Longitude_center", "Latitude_center"]
PARTS["deg_binned"] = "SELECT *, CAST(floor(Longitude / (1 / 111.32e0 * res_km)) AS INT) AS x_bin, CAST(floor(Latitude / (1 / 111.32e0 * res_km)) AS INT) AS y_bin FROM {pred_sited}, (SELECT unnest([50e0, 500e0, 2000e0]) AS res_km) r"
PARTS["deg_cells"] = f"SELECT res_km, x_bin, y_bin, {_CELL_STATS}, x_bin * (1 / 111.32e0 * res_km) + 1 / 111.32e0 * res_km / 2 AS Longitude_center, y_bin * (1 / 111.32e0 * res_km) + 1 / 111.32e0 * res_km / 2 AS Latitude_center FROM {{deg_binned}} GROUP BY res_km, x_bin, y_bin"


@query("grid_aggregate_degrees", "SELECT * FROM {deg_cells}", _CELL_DOUBLES)
def _(v):
    return g.grid_aggregate_degrees(v("pred_sited"), [50, 500, 2000])


PARTS["utm_points"] = forward_sql("Longitude", "Latitude", _EPSG, "{pred_sited}", "SSBS, SS, Observed, Predicted")
PARTS["utm_cells"] = f"SELECT res_km, epsg_code, x_bin, y_bin, {_CELL_STATS} FROM (SELECT *, CAST(floor(easting / (res_km * 1000)) AS INT) AS x_bin, CAST(floor(northing / (res_km * 1000)) AS INT) AS y_bin FROM {{utm_points}}, (SELECT unnest([25e0, 100e0, 500e0]) AS res_km) r) t GROUP BY res_km, epsg_code, x_bin, y_bin"
PARTS["utm_centres"] = inverse_sql("x_bin * (res_km * 1000) + res_km * 1000 / 2", "y_bin * (res_km * 1000) + res_km * 1000 / 2", "{utm_cells}", "res_km, x_bin, y_bin")


@query(
    "grid_aggregate_utm",
    "SELECT c.*, m.lon AS Longitude_center, m.lat AS Latitude_center FROM {utm_cells} c JOIN {utm_centres} m ON c.res_km = m.res_km AND c.epsg_code = m.epsg_code AND c.x_bin = m.x_bin AND c.y_bin = m.y_bin",
    _CELL_DOUBLES,
)
def _(v):
    return g.grid_aggregate_utm(v("pred_sited"), [25, 100, 500])


_CORR = "CASE WHEN count(*) >= 2 AND stddev_pop({0}) > 1e-8 AND stddev_pop({1}) > 1e-8 THEN covar_pop({0}, {1}) / (stddev_pop({0}) * stddev_pop({1})) END"


@query(
    "resolution_summary",
    f"SELECT res_km, {_CORR.format('Observed_mean', 'Predicted_mean')} AS Pearson_r, round(avg(Site_count), 1) AS avg_sites, round(avg(Study_count), 1) AS avg_studies FROM {{deg_cells}} GROUP BY res_km "
    f"UNION ALL SELECT 0e0, {_CORR.format('Observed', 'Predicted')}, 1e0, 1e0 FROM {{pred_sited}}",
    "res_km Pearson_r avg_sites avg_studies",
)
def _(v):
    pred = v("pred_sited")
    return g.resolution_summary(g.grid_aggregate_degrees(pred, [50, 500, 2000]), pred)
