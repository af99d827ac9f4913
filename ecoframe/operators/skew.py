"""Joins and look-ups that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ecoframe.functions.nulls import all_of, col, keys_match

# Rows of one key that share a join cell per side; a cell then yields at most BLOCK_ROWS**2 rows.
BLOCK_ROWS = 2048
# Where pairs are the result: small sides make many pairs, so tasks are dealt by pairs, not by bytes.
PAIR_BLOCK_ROWS = 1024
PAIRS_PER_TASK = 1_000_000
COPIES_PER_TASK = 250_000  # of rows put in several cells
MAX_TASKS = 20_000


def attach(df: DataFrame, table: DataFrame, keys: list[str], null_safe: bool = True) -> DataFrame:
    """Left join of a one-row-per-key table (the second half of "aggregate, then join back").

    Replaces ``over(partitionBy(keys))``: the aggregate combines map-side, and the join either
    broadcasts (Spark checks the size) or is split by AQE when a key is hot, while a window would
    sort a hot key's rows in one task.
    """
    if not null_safe:
        return df.join(table, keys, "left")
    left, right = df.alias("l"), table.alias("r")
    extra = [F.col(f"r.`{c}`") for c in table.columns if c not in keys]
    return left.join(right, keys_match("l", "r", keys), "left").select("l.*", *extra)


def blocked_pairs(df: DataFrame, keys: list[str], name: str, pairs_per_task: int, block_rows: int = PAIR_BLOCK_ROWS // 2) -> DataFrame:
    """Every two rows of a key once, as columns ``<c>_1`` and ``<c>_2`` with ``name_1 < name_2``.

    As :func:`blocked_join` of ``df`` with itself, which makes every pair in both orders to drop one. Rows of a
    key are ranked by ``name``, unique in it, and cut into blocks of that order; a cell is two blocks, the
    first not behind the second, so only pairs inside one block meet twice. ``df`` should be a written table.
    """
    from ecoframe.operators.ranking import rank_within

    own = [c for c in df.columns if c not in keys]
    known = df.filter(all_of([col(k).isNotNull() for k in [*keys, name]]))
    n = F.col("__n").cast("double")
    blocks = F.ceil(n / block_rows)
    sizes = known.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("__n"))
    n_pairs, n_copies = (x or 0.0 for x in sizes.agg(F.sum(n * n) / 2, F.sum(n * (blocks + 1) / 2)).first())
    placed = rank_within(known, keys, [col(name)]).withColumn("__block", F.floor(F.col("position") / block_rows).cast("int"))
    placed = placed.withColumn("__last", F.floor((F.col("group_size") - 1) / block_rows).cast("int"))
    makers = min(math.ceil(n_copies / COPIES_PER_TASK), MAX_TASKS)
    if makers > 1:
        placed = placed.repartition(makers, *[col(k) for k in keys], col(name))

    def side(number: int, block: str, other: str, ends: tuple) -> DataFrame:
        renamed = [col(c).alias(f"{c}_{number}") for c in own]
        return placed.select(*[col(k) for k in keys], *renamed, F.col("__block").alias(block), F.explode(F.sequence(*ends)).alias(other))

    one = side(1, "__low", "__high", (F.col("__block"), F.col("__last")))
    two = side(2, "__high", "__low", (F.lit(0), F.col("__block")))
    cell = ["__low", "__high"]
    tasks = min(math.ceil(n_pairs / pairs_per_task), MAX_TASKS)
    if tasks > 1:
        dealt = [col(k) for k in keys + cell]
        one, two = one.repartition(tasks, *dealt), two.repartition(tasks, *dealt).hint("merge")
    met = one.join(two, keys + cell)
    return met.filter((F.col("__low") < F.col("__high")) | (col(f"{name}_1") < col(f"{name}_2"))).drop(*cell)


def blocked_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_split: list[str],
    right_split: list[str],
    block_rows: int = BLOCK_ROWS,
    pairs_per_task: int | None = None,
) -> DataFrame:
    """Inner equi-join whose hot keys are cut into a grid of cells.

    A key with L left and R right rows becomes ceil(L/b) x ceil(R/b) cells: left rows pick a cell
    row by the hash of ``left_split`` and are copied along the cell columns, right rows the other
    way round. Every pair meets in exactly one cell, so the result is the plain join, but no task
    has to produce more than about b*b rows of one key. Keys below the block size stay single.

    With ``pairs_per_task`` the pairs are counted first, from the sizes of the keys, and the cells dealt
    to that many tasks. Both sides are then read twice and should be written tables. Their rows are dealt
    by the number of copies as well before they are copied, as a small table of a large key makes very many.
    """
    n_left = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n_left"))
    n_right = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n_right"))
    sizes = n_left.join(n_right, keys)
    grid = (
        sizes.select(
            *keys,
            F.ceil(F.col("__n_left") / block_rows).cast("int").alias("__cut_left"),
            F.ceil(F.col("__n_right") / block_rows).cast("int").alias("__cut_right"),
        )
        .filter((F.col("__cut_left") > 1) | (F.col("__cut_right") > 1))
    )
    cut_left = F.coalesce(F.col("__cut_left"), F.lit(1))
    cut_right = F.coalesce(F.col("__cut_right"), F.lit(1))

    def cell(names: list[str], cuts):
        return F.pmod(F.xxhash64(*[col(n) for n in names]), cuts.cast("long")).cast("int")

    n_pairs = 0.0
    left_placed, right_placed = left.join(grid, keys, "left"), right.join(grid, keys, "left")
    if pairs_per_task:
        rows_left, rows_right = F.col("__n_left").cast("double"), F.col("__n_right").cast("double")
        totals = (rows_left * rows_right, rows_left * F.ceil(rows_right / block_rows), rows_right * F.ceil(rows_left / block_rows))
        n_pairs, *copies = (n or 0.0 for n in sizes.agg(*[F.sum(t) for t in totals]).first())

        def spread(placed: DataFrame, names: list[str], n_copies: float) -> DataFrame:
            makers = min(math.ceil(n_copies / COPIES_PER_TASK), MAX_TASKS)
            return placed.repartition(makers, *[col(c) for c in keys + names]) if makers > 1 else placed

        left_placed, right_placed = spread(left_placed, left_split, copies[0]), spread(right_placed, right_split, copies[1])

    left_cells = left_placed.select(
        *[col(c) for c in left.columns],
        cell(left_split, cut_left).alias("__cell_left"),
        F.explode(F.sequence(F.lit(0), cut_right - 1)).alias("__cell_right"),
    )
    right_cells = right_placed.select(
        *[col(c) for c in right.columns],
        F.explode(F.sequence(F.lit(0), cut_left - 1)).alias("__cell_left"),
        cell(right_split, cut_right).alias("__cell_right"),
    )
    cells = ["__cell_left", "__cell_right"]
    if pairs_per_task:
        tasks = min(math.ceil(n_pairs / pairs_per_task), MAX_TASKS)
        if tasks > 1:
            dealt = [col(k) for k in keys + cells]
            left_cells, right_cells = left_cells.repartition(tasks, *dealt), right_cells.repartition(tasks, *dealt).hint("merge")
    return left_cells.join(right_cells, keys + cells).drop(*cells)
