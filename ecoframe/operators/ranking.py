"""Exact ranks, bins and quantiles without one-task windows.

All functions rest on one step: a range sort on (keys, order columns) whose blocks are written to
the shared scratch area. A row's rank inside its key is then the number of rows of that key in
earlier blocks (a tiny per-block table) plus its place inside the block. A key that holds a large
share of the data simply spans many blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ecoframe.functions.nulls import col, is_finite, keys_match
from ecoframe.operators.skew import attach
from ecoframe.session import materialise

BINS = 4096  # counted before values of very large keys are sorted
_BLOCK_BITS = 33  # monotonically_increasing_id keeps the partition number above this bit


def sorted_blocks(df: DataFrame, order: list[Column]) -> DataFrame:
    """Range-sorted copy of ``df`` with the columns ``__block`` and ``__place``."""
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__id", F.monotonically_increasing_id())
    )
    return (
        materialise(placed, "sorted")
        .withColumn("__block", F.shiftright(F.col("__id"), _BLOCK_BITS))
        .withColumn("__place", F.col("__id").bitwiseAND(F.lit((1 << _BLOCK_BITS) - 1)))
        .drop("__id")
    )


def _block_table(blocks: DataFrame, keys: list[str], weight: Column) -> DataFrame:
    """Per (key, block): rows before it inside the key, rows in it, rows of the whole key."""
    per_block = blocks.groupBy(*keys, "__block").agg(
        F.sum(weight).alias("__here"), F.min("__place").alias("__first")
    )
    # One row per key and block, so each window group is at most the number of blocks long.
    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    return per_block.select(
        *keys,
        "__block",
        "__first",
        "__here",
        (F.sum("__here").over(by_key.orderBy("__block")) - F.col("__here")).alias("__before"),
        F.sum("__here").over(by_key).alias("group_size"),
    )


def rank_within(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Add ``position`` (0-based rank inside the key) and ``group_size``.

    ``order`` must be unique inside a key (end it with an id), which also makes ties stable.
    """
    blocks = sorted_blocks(df, [col(k) for k in keys] + order)
    table = _block_table(blocks, keys, F.lit(1).cast("long"))
    return attach(blocks, table, keys + ["__block"]).select(
        *[col(c) for c in df.columns],
        (F.col("__before") + F.col("__place") - F.col("__first")).alias("position"),
        F.col("group_size"),
    )


def rank_bins(df: DataFrame, column: str, k: int, tiebreak: list[str], keys: list[str] | None = None) -> DataFrame:
    """Equal-count bins 0..k-1 by rank, with integer edges floor(i * n / k)."""
    order = [col(column)] + [col(t) for t in tiebreak]
    ranked = rank_within(df, keys or [], order)
    # bin = ceil(k * rn / n) - 1 for the 1-based rank rn, in integer arithmetic
    last = F.floor(((F.col("position") + 1) * k - 1) / F.col("group_size"))
    return ranked.select(*[col(c) for c in df.columns], last.cast("int").alias("bin"))


def average_rank(df: DataFrame, column: str, keys: list[str] | None = None, name: str = "avg_rank") -> DataFrame:
    """Tie-averaged 1-based rank of ``column``; null values get no rank."""
    keys = keys or []
    counts = (
        df.filter(col(column).isNotNull())
        .groupBy(*[col(c) for c in keys + [column]])
        .agg(F.count(F.lit(1)).alias("__w"))
    )
    running = running_weight(counts, keys, [col(column)], "__w")
    ranks = running.select(
        *keys, column, (F.col("before") + (F.col("__w") + 1) / 2).alias(name)
    )
    return attach(df, ranks, keys + [column])


def running_weight(df: DataFrame, keys: list[str], order: list[Column], weight: str) -> DataFrame:
    """Add ``before``: summed weight of the rows sorted earlier inside the key.

    Two levels: totals of earlier blocks from the block table, and a running sum inside one block.
    """
    blocks = sorted_blocks(df, [col(k) for k in keys] + order)
    table = _block_table(blocks, keys, col(weight)).drop("__first")
    inside = Window.partitionBy(*keys, "__block").orderBy("__place").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = blocks.withColumn("__local", F.sum(col(weight)).over(inside) - col(weight))
    return attach(local, table, keys + ["__block"]).select(
        *[col(c) for c in df.columns],
        (F.col("__before") + F.col("__local")).alias("before"),
        F.col("group_size"),
    )


def quantiles(
    df: DataFrame,
    keys: list[str],
    column: str,
    probs: dict[str, float],
    method: str = "nearest",
) -> DataFrame:
    """Exact quantiles per key: one row per key, one column per entry of ``probs``.

    ``nearest`` takes the element at round((n-1)*q) (halves away from zero), ``linear``
    interpolates between the two neighbours. Equal values are counted map-side first, then only
    the blocks that contain a wanted element are looked into.
    """
    if method not in ("nearest", "linear"):
        raise ValueError(f"Unsupported method: {method}")
    counts = (
        df.filter(is_finite(col(column)))
        .groupBy(*[col(k) for k in keys], col(column).cast("double").alias("__v"))
        .agg(F.count(F.lit(1)).alias("__w"))
    )
    blocks = sorted_blocks(counts, [col(k) for k in keys] + [F.col("__v")])
    table = _block_table(blocks, keys, F.col("__w"))

    span = F.col("group_size") - 1
    wanted = []
    for name, q in probs.items():
        exact = span * F.lit(float(q))
        if method == "nearest":
            rank = F.round(exact).cast("long")
            wanted.append(F.struct(F.lit(name).alias("q"), F.lit(0).alias("side"), rank.alias("rank"), F.lit(1.0).alias("share")))
        else:
            low = F.floor(exact).cast("long")
            share = exact - F.floor(exact)
            wanted.append(F.struct(F.lit(name).alias("q"), F.lit(0).alias("side"), low.alias("rank"), (1 - share).alias("share")))
            wanted.append(F.struct(F.lit(name).alias("q"), F.lit(1).alias("side"), F.ceil(exact).cast("long").alias("rank"), share.alias("share")))
    targets = (
        table.withColumn("__t", F.explode(F.array(*wanted)))
        .select(*keys, "__block", "__before", "__here", "__t.q", "__t.side", "__t.rank", "__t.share")
        .filter((F.col("rank") >= F.col("__before")) & (F.col("rank") < F.col("__before") + F.col("__here")))
        .groupBy(*keys, "__block", "__before")
        .agg(F.collect_list(F.struct("q", "side", "rank", "share")).alias("__t"))  # at most 2 per prob
    )
    on = keys + ["__block"]
    left, right = blocks.alias("l"), targets.alias("r")
    inside = Window.partitionBy(*on).orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    picked = (
        left.join(right, keys_match("l", "r", on))
        .select("l.*", "r.__before", "r.__t")
        .withColumn("__upto", F.col("__before") + F.sum("__w").over(inside))
        .withColumn("__t", F.explode("__t"))
        .filter((F.col("__t.rank") < F.col("__upto")) & (F.col("__t.rank") >= F.col("__upto") - F.col("__w")))
    )
    out = [
        F.sum(F.when(F.col("__t.q") == name, F.col("__v") * F.col("__t.share"))).alias(name)
        for name in probs
    ]
    return picked.groupBy(*keys).agg(*out)


def quantiles_of_few_keys(df: DataFrame, keys: list[str], column: str, probs: dict[str, float]) -> DataFrame:
    """:func:`quantiles` (``nearest``) of a written table with very many rows per key, of which few are shuffled.

    Rows are first counted in ``BINS`` even steps between the ends of their key. Only values of the bins that
    hold a wanted element are counted by value and sorted; a bin that holds most rows costs what all did.
    """
    value = col(column).cast("double")
    finite = df.filter(is_finite(col(column))).select(*[col(k) for k in keys], value.alias("__v"))
    ends = finite.groupBy(*keys).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.count(F.lit(1)).alias("__n"))
    ends = materialise(ends, "ends")
    # Halves, as the span of two finite values may be infinite. Each step keeps the order of values.
    span = F.col("__hi") / 2 - F.col("__lo") / 2
    share = F.when(span > 0, (F.col("__v") / 2 - F.col("__lo") / 2) / span).otherwise(F.lit(0.0))
    binned = attach(finite, ends, keys).withColumn("__bin", F.floor(share * BINS).cast("int"))
    sizes = materialise(binned.groupBy(*keys, "__n", "__bin").agg(F.count(F.lit(1)).alias("__here")), "bins")
    # At most BINS + 1 rows a key.
    by_key = Window.partitionBy(*[col(k) for k in keys]) if keys else Window.partitionBy(F.lit(1))
    placed = sizes.withColumn("__before", F.sum("__here").over(by_key.orderBy("__bin")) - F.col("__here"))
    rank = {name: F.round((F.col("__n") - 1) * F.lit(float(q))).cast("long") for name, q in probs.items()}
    asked = F.array(*[F.struct(F.lit(name).alias("q"), r.alias("rank")) for name, r in rank.items()])
    targets = materialise(
        placed.withColumn("__t", F.explode(asked)).select(*keys, "__bin", "__before", "__here", "__t.q", "__t.rank")
        .filter((F.col("rank") >= F.col("__before")) & (F.col("rank") < F.col("__before") + F.col("__here"))),
        "targets",
    )
    wanted = targets.select(*keys, "__bin").distinct().alias("r")
    held = binned.alias("l").join(wanted, keys_match("l", "r", [*keys, "__bin"]), "left_semi")
    counts = held.groupBy(*keys, "__bin", "__v").agg(F.count(F.lit(1)).alias("__w"))
    running = running_weight(counts, [*keys, "__bin"], [F.col("__v")], "__w").select(*keys, "__bin", "__v", "__w", "before").alias("l")
    at = F.col("r.rank") - F.col("r.__before")
    inside = keys_match("l", "r", [*keys, "__bin"]) & (at >= F.col("l.before")) & (at < F.col("l.before") + F.col("l.__w"))
    picked = running.join(targets.alias("r"), inside).select("l.*", "r.q")
    return picked.groupBy(*keys).agg(*[F.max(F.when(F.col("q") == name, F.col("__v"))).alias(name) for name in probs])


def quantile_nearest(df: DataFrame, keys: list[str], column: str, q: float, name: str) -> DataFrame:
    return quantiles(df, keys, column, {name: q}, "nearest")


def dense_index(df: DataFrame, column: str, name: str = "idx") -> DataFrame:
    """Distinct labels with a stable 0-based index in label order."""
    labels = df.select(col(column)).filter(col(column).isNotNull()).distinct()
    return rank_within(labels, [], [col(column)]).select(
        col(column), F.col("position").cast("int").alias(name)
    )


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key under ``order``: an aggregate, so it combines map-side."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    row = F.min_by(F.struct(*[col(c) for c in rest]), F.struct(*[col(o) for o in order]))
    return (
        df.groupBy(*[col(k) for k in keys])
        .agg(row.alias("__row"))
        .select(*[col(k) for k in keys], *[F.col("__row").getField(c).alias(c) for c in rest])
        .select(*[col(c) for c in df.columns])
    )


def attributes_per_key(df: DataFrame, keys: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """``columns`` of the first row of every key under ``order``, for columns that hardly vary.

    Distinct rows come first: a hash aggregate that combines map-side and leaves about one row per
    key, where :func:`first_per_key` would sort whole rows. Only keys with differing rows are looked
    up in ``df`` again, by order.
    """
    wanted = [col(c) for c in [*keys, *columns]]
    rows = materialise(df.select(*wanted).distinct(), "attributes")
    repeated = rows.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 1)
    repeated = materialise(repeated.drop("__n"), "varying")
    if repeated.isEmpty():
        return rows
    names = list(dict.fromkeys([*keys, *columns, *order]))
    left, right = df.select(*[col(c) for c in names]).alias("l"), repeated.alias("r")
    firsts = first_per_key(left.join(right, keys_match("l", "r", keys), "left_semi"), keys, order).select(*wanted)
    single = rows.alias("l").join(right, keys_match("l", "r", keys), "left_anti").select(*wanted)
    return single.unionByName(firsts)
