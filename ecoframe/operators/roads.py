"""Road length inside polygons: union of overlapping stretches, quadtree covers, cells instead of pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from ecoframe.functions.nulls import col, is_finite
from ecoframe.operators import geo
from ecoframe.session import materialise

PER_METRE = 1000  # steps of the exact grid on which lines are compared
STRETCH_M = 1000.0
CELL_M = 500.0
COVER_ROWS = 256  # polygons covered at a time
DEPTH = 2  # halvings from the largest cell of a cover to the ones at its rim
RIM_ROWS, RIM_PIECES = 1024, 2048  # polygons and pieces of a cell that meet at once
CACHED_PAIRS = 1 << 14
PIECE = ["x1", "y1", "x2", "y2", "length"]

_STEPS = ["__x1", "__y1", "__x2", "__y2"]


def union_segments(segments: DataFrame, keys: list[str], per_metre: int = PER_METRE, stretch_m: float = STRETCH_M) -> DataFrame:
    """Disjoint segments that cover what ``segments`` (x1, y1, x2, y2) cover, per ``keys``.

    Stretches that several collinear segments share count once, whichever way they run. Coordinates
    are taken in whole steps of 1 / ``per_metre``, in which being on one line is exact: a line is its reduced
    direction and its offset. Along a line the segments are intervals, merged in order of their start.
    Lines are cut every ``stretch_m``, so a line that very many segments share is dealt to many
    tasks. Segments without length or with an invalid coordinate are left out.
    """
    names = ["x1", "y1", "x2", "y2"]
    valid = [is_finite(F.col(n)) for n in names]
    rows = segments.where(valid[0] & valid[1] & valid[2] & valid[3])
    rows = rows.select(*[col(k) for k in keys], *[F.round(F.col(n) * per_metre).cast("long").alias(s) for n, s in zip(names, _STEPS)])
    # Directed to the right, or upwards: turning a segment round changes nothing.
    turned = "(__x1 > __x2 OR (__x1 = __x2 AND __y1 > __y2))"
    rows = rows.selectExpr(
        *[f"`{k}`" for k in keys], 
        f"CASE WHEN {turned} THEN __x2 ELSE __x1 END AS __x1", f"CASE WHEN {turned} THEN __y2 ELSE __y1 END AS __y1",
        f"CASE WHEN {turned} THEN __x1 - __x2 ELSE __x2 - __x1 END AS __dx",
        f"CASE WHEN {turned} THEN __y1 - __y2 ELSE __y2 - __y1 END AS __dy",
        "least(__x1, __x2) AS __xa", "greatest(__x1, __x2) AS __xb", "least(__y1, __y2) AS __ya", "greatest(__y1, __y2) AS __yb",
    ).where("__dx <> 0 OR __dy <> 0").distinct()
    # Euclid's algorithm takes at most 48 divisions below 2^33.
    divisor = """CASE WHEN __dx = 0 THEN abs(__dy) WHEN __dy = 0 THEN __dx ELSE
        aggregate(sequence(1, 48), named_struct('a', __dx, 'b', abs(__dy)),
            (s, i) -> CASE WHEN s.b = 0 THEN s ELSE named_struct('a', s.b, 'b', s.a % s.b) END, s -> s.a) END"""
    rows = rows.withColumn("__g", F.expr(divisor)).selectExpr(
        *[f"`{k}`" for k in keys], "__x1", "__y1", "__xa", "__xb", "__ya", "__yb", "__dx div __g AS __ux", "__dy div __g AS __uy"
    )
    wide = "decimal(19,0)"
    # Intervals lie along the axis that the line is nearer to.
    lines = rows.selectExpr(
        *[f"`{k}`" for k in keys], "__ux", "__uy",
        f"cast(cast(__ux AS {wide}) * cast(__y1 AS {wide}) - cast(__uy AS {wide}) * cast(__x1 AS {wide}) AS decimal(38,0)) AS __c",
        "CASE WHEN __ux >= abs(__uy) THEN __xa ELSE __ya END AS __a", "CASE WHEN __ux >= abs(__uy) THEN __xb ELSE __yb END AS __b",
    )
    stretch = int(stretch_m * per_metre)
    cut = lines.withColumn("__k", F.expr(f"explode(sequence(cast(floor(__a / {stretch}) AS bigint), cast(floor((__b - 1) / {stretch}) AS bigint)))"))
    cut = cut.withColumn("__a", F.expr(f"greatest(__a, __k * {stretch})")).withColumn("__b", F.expr(f"least(__b, (__k + 1) * {stretch})"))
    line = [*keys, "__ux", "__uy", "__c", "__k"]
    in_order = Window.partitionBy(*[col(n) for n in line]).orderBy("__a", "__b")
    reached = F.max("__b").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    starts = cut.withColumn("__new", F.when(F.col("__a") <= reached, 0).otherwise(1))
    islands = starts.withColumn("__island", F.sum("__new").over(in_order))
    merged = islands.groupBy(*[col(n) for n in line], "__island").agg(F.min("__a").alias("__a"), F.max("__b").alias("__b"))

    def point(m: str) -> tuple[str, str]:
        """x and y of a place along the line, in metres."""
        y = f"cast(__c + cast(__uy AS {wide}) * cast({m} AS {wide}) AS double) / __ux"
        x = f"cast(cast(__ux AS {wide}) * cast({m} AS {wide}) - __c AS double) / __uy"
        flat = "__ux >= abs(__uy)"
        return f"CASE WHEN {flat} THEN {m} ELSE {x} END / {per_metre}", f"CASE WHEN {flat} THEN {y} ELSE {m} END / {per_metre}"

    ends = [*point("__a"), *point("__b")]
    return merged.selectExpr(*[f"`{k}`" for k in keys], *[f"cast({e} AS double) AS {n}" for e, n in zip(ends, names)])


def cell_pieces(segments: DataFrame, keys: list[str], unit: float = CELL_M) -> DataFrame:
    """Segments cut at the lines of a grid: (keys, cx, cy, x1, y1, x2, y2, length), each piece in one cell."""

    def crossings(a: str, b: str) -> str:
        low, high = f"ceil(least({a}, {b}) / {unit})", f"floor(greatest({a}, {b}) / {unit})"
        return (
            f"CASE WHEN {a} <> {b} AND {low} <= {high} THEN transform(sequence(cast({low} AS bigint), cast({high} AS bigint)), "
            f"k -> least(1D, greatest(0D, (k * {unit} - {a}) / ({b} - {a})))) ELSE array() END"
        )

    stops = f"array_sort(array_distinct(concat(array(0D, 1D), {crossings('x1', 'x2')}, {crossings('y1', 'y2')})))"
    one_cell = " AND ".join(f"floor({a} / {unit}) = floor({b} / {unit})" for a, b in (("x1", "x2"), ("y1", "y2")))
    spans = f"CASE WHEN {one_cell} THEN array(0D, 1D) ELSE {stops} END"
    both = "explode(transform(sequence(1, size(__t) - 1), i -> named_struct('a', __t[i - 1], 'b', __t[i])))"
    parts = segments.withColumn("__t", F.expr(spans)).withColumn("__s", F.expr(both))

    def at(t: str, axis: str) -> str:
        return f"CASE WHEN __s.{t} = 1D THEN {axis}2 ELSE {axis}1 + __s.{t} * ({axis}2 - {axis}1) END"

    ends = [f"{at(t, axis)} AS __{axis}{n}" for n, t in ((1, "a"), (2, "b")) for axis in "xy"]
    pieces = parts.selectExpr(*[f"`{k}`" for k in keys], *ends)
    return pieces.selectExpr(
        *[f"`{k}`" for k in keys],
        f"cast(floor((__x1 + __x2) / 2 / {unit}) AS bigint) AS cx", f"cast(floor((__y1 + __y2) / 2 / {unit}) AS bigint) AS cy",
        "__x1 AS x1", "__y1 AS y1", "__x2 AS x2", "__y2 AS y2",
        "sqrt((__x2 - __x1) * (__x2 - __x1) + (__y2 - __y1) * (__y2 - __y1)) AS length",
    )


def quad_cover(polygons: DataFrame, keys: list[str], unit: float = CELL_M, depth: int = DEPTH) -> DataFrame:
    """Quadtree cells that cover convex polygons: (keys, level, cx, cy, inside, edges).

    A cell of ``level`` is ``unit`` * 2^level wide. The first cells are about half as wide as the polygon;
    those at its rim are halved up to ``depth`` times, cells inside stay large. ``edges`` are those sides of the
    polygon that reach the cell, and empty inside. Polygons without area have no cells.
    """
    shaped = polygons.where(F.size("polygon") >= 4).select(*[col(k) for k in keys], "polygon")
    edge = pa.struct([(n, pa.float64()) for n in ("nx", "ny", "c")])
    found = StructType([shaped.schema[k] for k in keys] + [
        StructField("level", IntegerType()), StructField("cx", LongType()), StructField("cy", LongType()), StructField("inside", BooleanType()),
        StructField("edges", ArrayType(StructType([StructField(n, DoubleType()) for n in ("nx", "ny", "c")]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, COVER_ROWS):
                part = batch.slice(begin, COVER_ROWS)
                rings = part.column("polygon")
                corners = rings.flatten()
                who, level, x, y, inside, edges, n_edges = _cover(
                    np.asarray(corners.field("x")), np.asarray(corners.field("y")), np.asarray(rings.value_lengths()), unit, depth
                )
                ends = np.concatenate([[0], np.cumsum(n_edges)]).astype(np.int32)
                sides = pa.StructArray.from_arrays([pa.array(e) for e in edges], fields=list(edge))
                columns = [pa.array(level), pa.array(x), pa.array(y), pa.array(inside), pa.ListArray.from_arrays(pa.array(ends), sides)]
                yield pa.RecordBatch.from_arrays([*[part.column(k).take(pa.array(who)) for k in keys], *columns], names=found.names)

    return shaped.mapInArrow(run, found)


def _cover(px: np.ndarray, py: np.ndarray, sizes: np.ndarray, unit: float, depth: int):
    """(polygon, level, x, y, inside, flat edges, edges per cell) of rings given by flat corners."""
    n, most = len(sizes), int(sizes.max()) - 1
    starts = np.cumsum(sizes) - sizes
    # Edges as rows of equal length; what shorter rings lack is true everywhere.
    place = np.minimum(np.arange(most), (sizes - 2)[:, None])
    lacking = np.arange(most) >= (sizes - 1)[:, None]
    x1, y1, x2, y2 = px[starts[:, None] + place], py[starts[:, None] + place], px[starts[:, None] + place + 1], py[starts[:, None] + place + 1]
    nx, ny = np.where(lacking, 0.0, y1 - y2), np.where(lacking, 0.0, x2 - x1)
    c = np.where(lacking, -1.0, nx * x1 + ny * y1)
    corners = (sizes - 1).astype(float)
    mx, my = np.where(lacking, 0, x1).sum(axis=1) / corners, np.where(lacking, 0, y1).sum(axis=1) / corners
    steep = np.hypot(nx, ny)
    gaps = np.where(steep > 0, (nx * mx[:, None] + ny * my[:, None] - c) / np.where(steep > 0, steep, 1), np.inf)
    within, around = np.maximum(gaps.min(axis=1), 0) ** 2, ((x1 - mx[:, None]) ** 2 + (y1 - my[:, None]) ** 2).max(axis=1)
    width = np.maximum(x1.max(axis=1) - x1.min(axis=1), y1.max(axis=1) - y1.min(axis=1))
    top = np.maximum(0, np.ceil(np.log2(np.maximum(width, unit) / (2 * unit)))).astype(np.int64)
    rim = np.maximum(0, top - depth)

    def values(who, level, x, y):
        size = unit * (1 << level)
        value = nx[who] * ((x + 0.5) * size)[:, None] + ny[who] * ((y + 0.5) * size)[:, None] - c[who]
        return value, (np.abs(nx[who]) + np.abs(ny[who])) * (size / 2)[:, None]

    def judged(who, level, x, y):
        """The cells that are not outside, and whether they are inside. Most are settled by circles."""
        size = unit * (1 << level)
        dx, dy, half = np.abs((x + 0.5) * size - mx[who]), np.abs((y + 0.5) * size - my[who]), size / 2
        inside = (dx + half) ** 2 + (dy + half) ** 2 <= within[who]
        out = np.maximum(dx - half, 0) ** 2 + np.maximum(dy - half, 0) ** 2 > around[who]
        open_ = np.flatnonzero(~inside & ~out)
        value, reach = values(who[open_], level[open_], x[open_], y[open_])
        out[open_] = (value < -reach).any(axis=1)
        inside[open_] = (value >= reach).all(axis=1)
        kept = ~out
        return who[kept], level[kept], x[kept], y[kept], inside[kept]

    size = unit * (1 << top)
    x_lo, y_lo = np.floor(x1.min(axis=1) / size).astype(np.int64), np.floor(y1.min(axis=1) / size).astype(np.int64)
    nx_cells, ny_cells = np.floor(x1.max(axis=1) / size).astype(np.int64) - x_lo + 1, np.floor(y1.max(axis=1) / size).astype(np.int64) - y_lo + 1
    nx_cells, ny_cells = np.where(width > 0, nx_cells, 0), np.where(width > 0, ny_cells, 0)
    who = np.repeat(np.arange(n), nx_cells * ny_cells)
    number = np.arange(len(who)) - np.repeat(np.cumsum(nx_cells * ny_cells) - nx_cells * ny_cells, nx_cells * ny_cells)
    cells = judged(who, top[who], x_lo[who] + number % nx_cells[who], y_lo[who] + number // nx_cells[who])
    done = []
    for _ in range(depth + 1):
        who, level, x, y, inside = cells
        final = inside | (level <= rim[who])
        done.append([v[final] for v in cells])
        who, level, x, y = (np.repeat(v[~final], 4) for v in (who, level, x, y))
        quarter = np.arange(len(who)) % 4
        cells = judged(who, level - 1, 2 * x + quarter % 2, 2 * y + quarter // 2)
    who, level, x, y, inside = (np.concatenate(v) for v in zip(*done))
    order = np.argsort(inside, kind="stable")  # rim first
    who, level, x, y, inside = who[order], level[order], x[order], y[order], inside[order]
    at_rim = np.flatnonzero(~inside)
    value, reach = values(who[at_rim], level[at_rim], x[at_rim], y[at_rim])
    near = (value <= reach) & ~lacking[who[at_rim]]
    row, side = np.nonzero(near)
    chosen = who[at_rim][row], side
    n_edges = np.zeros(len(who), dtype=np.int64)
    n_edges[at_rim] = near.sum(axis=1)
    return who, level.astype(np.int32), x, y, inside, (nx[chosen], ny[chosen], c[chosen]), n_edges


def _ancestors(df: DataFrame, levels: list[int], keep: list[Column]) -> DataFrame:
    """Rows listed under their cell of each of ``levels``."""
    listed = df.withColumn("level", F.explode(F.array(*[F.lit(n) for n in levels])))
    up = [F.expr(f"shiftright({c}, level)").alias(c) for c in ("cx", "cy")]
    return listed.select(*keep, "level", *up)


def _packed(df: DataFrame, cell: list[str], split: list[str], size: int, name: str) -> DataFrame:
    """(cell, part, ``name``): the other columns of ``df`` as lists of about ``size`` rows of a cell."""
    rest = [c for c in df.columns if c not in cell]
    n = df.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("__parts"))
    dealt = df.join(n, cell).withColumn("part", F.pmod(F.xxhash64(*split), F.col("__parts")).cast("int"))
    return dealt.groupBy(*cell, "part").agg(F.collect_list(F.struct(*rest)).alias(name))


def _rim_lengths(rim: DataFrame, pieces: DataFrame, cell: list[str]) -> DataFrame:
    """(__id, length): length of the ``pieces`` of a cell inside the sides (``edges``) of each ``rim`` row of it.

    Both sides are packed into lists of bounded size, of which every two of a cell meet once.
    """
    pieces = _packed(pieces, cell, PIECE, RIM_PIECES, "pieces")
    parts = pieces.groupBy(*cell).agg(F.max("part").alias("last"))
    rows = _packed(rim, cell, ["__id"], RIM_ROWS, "rim").drop("part").join(parts, cell)
    met = rows.withColumn("part", F.explode(F.sequence(F.lit(0), "last"))).join(pieces, [*cell, "part"]).select("rim", "pieces")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rim, road in zip(batch.column("rim"), batch.column("pieces")):
                ids, edges = rim.values.flatten()
                sides = [np.asarray(v) for v in edges.flatten().flatten()]
                length = _clipped(*sides, np.asarray(edges.value_lengths()), *[np.asarray(v) for v in road.values.flatten()])
                yield pa.RecordBatch.from_arrays([ids.filter(pa.array(length > 0)), pa.array(length[length > 0])], names=["__id", "length"])

    return met.mapInArrow(run, StructType([StructField("__id", LongType()), StructField("length", DoubleType())]))


def _clipped(nx, ny, c, n_sides, x1, y1, x2, y2, length) -> np.ndarray:
    """Length of all pieces inside each polygon, by parametric clipping.

    Polygons are ``n_sides`` consecutive half-planes nx * x + ny * y >= c. A piece enters at the largest parameter
    over the sides it crosses inwards and leaves at the smallest over those it crosses outwards.
    """
    starts = np.cumsum(n_sides) - n_sides
    order = np.argsort(-n_sides, kind="stable")  # those with an n-th side come first
    dx, dy = x2 - x1, y2 - y1
    out = np.zeros(len(n_sides))
    rows = max(1, CACHED_PAIRS // len(x1))
    for begin in range(0, len(order), rows):
        who = order[begin : begin + rows]
        enter, leave = np.zeros((len(who), len(x1))), np.ones((len(who), len(x1)))
        for n in range(n_sides[who[0]]):
            has = int((n_sides[who] > n).sum())
            at = starts[who[:has]] + n
            a, b = nx[at][:, None], ny[at][:, None]
            slope, side = a * dx + b * dy, a * x1 + b * y1 - c[at][:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                t = -side / slope
            enter[:has] = np.where(slope > 0, np.maximum(enter[:has], t), enter[:has])
            leave[:has] = np.where(slope < 0, np.minimum(leave[:has], t), np.where((slope == 0) & (side < 0), -1.0, leave[:has]))
        out[who] = np.maximum(leave - enter, 0) @ length
    return out


def road_density(
    polygons: DataFrame,
    segments: DataFrame,
    keys: list[str],
    cell_m: float = CELL_M,
    match_zone: bool = True,
    depth: int = DEPTH,
) -> DataFrame:
    """Length of roads inside every polygon (``Road_density``); each stretch of road counts once.

    Roads are united (:func:`union_segments`) and cut at a fine grid. A polygon is covered by quadtree cells:
    cells wholly inside take the total length of their cell, one row however many roads lie there;
    only cells at the rim meet the pieces themselves, with the few polygon sides that reach the cell.
    Every piece lies in exactly one cell of a cover. Polygons with the same corners are measured once.
    """
    zone = [F.col("epsg_code")] if match_zone else [F.lit(0).alias("epsg_code")]
    roads = union_segments(segments.select(*zone, "x1", "y1", "x2", "y2"), ["epsg_code"])
    pieces = materialise(cell_pieces(roads, ["epsg_code"], cell_m), "road-pieces")
    own = [f"__k{i}" for i in range(len(keys))]
    named = materialise(polygons.select(*zone, *[col(k).alias(n) for k, n in zip(keys, own)], "polygon"), "polygons")
    single = named.select("epsg_code", "polygon").distinct().withColumn("__id", F.monotonically_increasing_id())
    single = materialise(single, "shapes")
    # A table of sites is small in bytes and may come in one partition, but each row makes many cells.
    shapes = single.repartition(polygons.sparkSession.sparkContext.defaultParallelism)
    cover = materialise(quad_cover(shapes, ["epsg_code", "__id"], cell_m, depth), "cover")
    used = {r[0]: r[1] for r in cover.groupBy("inside").agg(F.collect_set("level")).collect()}  # a number per size of polygon
    cell = ["epsg_code", "level", "cx", "cy"]
    lengths = []
    if used.get(True):
        totals = pieces.groupBy("epsg_code", "cx", "cy").agg(F.sum("length").alias("length"))
        totals = _ancestors(totals, used[True], [F.col("epsg_code"), F.col("length")]).groupBy(*cell).agg(F.sum("length").alias("length"))
        lengths.append(cover.where("inside").join(totals, cell).select("__id", "length"))
    if used.get(False):
        rim = cover.where("NOT inside").select(*cell, "__id", "edges")
        listed = _ancestors(pieces, used[False], [F.col(c) for c in ("epsg_code", *PIECE)])
        lengths.append(_rim_lengths(rim, listed, cell))
    inside = None
    for part in lengths:
        inside = part if inside is None else inside.unionByName(part)
    if inside is None:
        return polygons.select(*[col(k) for k in keys], F.lit(0.0).alias("Road_density"))
    inside = inside.groupBy("__id").agg(F.sum("length").alias("length")).join(single, "__id")
    inside = named.join(inside, ["epsg_code", "polygon"]).groupBy(*own).agg(F.sum("length").alias("Road_density"))
    totals = inside.select(*[F.col(n).alias(k) for k, n in zip(keys, own)], "Road_density")
    return named.select(*[F.col(n).alias(k) for k, n in zip(keys, own)]).join(totals, keys, "left").withColumn(
        "Road_density", F.coalesce("Road_density", F.lit(0.0))
    )


def road_density_of_lines(
    sites: DataFrame, roads: DataFrame, radii_km: list[int] | None = None, shape: str = "round", parts: str = "parts"
) -> DataFrame:
    """(SSBS, radius_km, Road_density) from site coordinates and roads as multi-lines in degrees.

    Roads are split into lines, projected in the zone of their first point, and measured inside every
    buffer of the same zone, once per stretch.
    """
    lines = geo.project_lines(geo.split_multilines(roads.select(col(parts)), parts))
    buffers = geo.buffer_sites(sites, radii_km, shape)
    found = road_density(buffers.select("SSBS", "radius_km", "epsg_code", "polygon"), geo.line_segments(lines), ["SSBS", "radius_km"])
    return found.select("SSBS", "radius_km", "Road_density")
