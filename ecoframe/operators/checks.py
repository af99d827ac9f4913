"""Validation operators: reports as DataFrames, one aggregate each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ecoframe.functions.nulls import any_of, col, is_invalid, n_unique


def duplicate_rows(df: DataFrame, mode: str = "members") -> DataFrame:
    """Rows in duplicate sets: every member, or only the extras."""
    if mode not in ("members", "extras"):
        raise ValueError(f"Unsupported mode: {mode}")
    sizes = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    counted = F.col("__n") if mode == "members" else F.col("__n") - 1
    total = F.sum(F.when(F.col("__n") > 1, counted).otherwise(0))
    return sizes.agg(F.coalesce(total, F.lit(0)).cast("long").alias("n_duplicates"))


def unique_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(n_unique(col(column)).cast("long").alias("n_unique"))


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def no_nan(column: str) -> tuple[str, str, Column]:
    return column, "no_nan", F.isnan(col(column).cast("double"))


def within(column: str, low: float = 0.0, high: float = 1.0) -> tuple[str, str, Column]:
    return column, f"within_{low:g}_{high:g}", (col(column) < low) | (col(column) > high)


def non_negative(column: str) -> tuple[str, str, Column]:
    return column, "non_negative", col(column) < 0


def check_ranges(df: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """Violations per rule, all rules in one pass."""
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.lit(r).alias("rule"), _count(bad).alias("violations"))
            for c, r, bad in rules
        ]
    )
    return df.agg(rows.alias("r")).select(F.explode("r").alias("r")).select("r.*")


def check_alpha(df: DataFrame, metric: str) -> DataFrame:
    rules = [no_nan(c) for c in (metric, f"Scaled_{metric}", f"Study_max_{metric}")]
    rules += [non_negative(metric), non_negative(f"Study_max_{metric}"), within(f"Scaled_{metric}")]
    return check_ranges(df, rules)


def check_concat(a: DataFrame, b: DataFrame, out: DataFrame) -> DataFrame:
    """Rows and distinct sites add up, columns match and nothing is duplicated."""
    columns_match = set(out.columns) <= set(a.columns) & set(b.columns)

    def counts(df: DataFrame, tag: str) -> DataFrame:
        return df.agg(
            F.count(F.lit(1)).alias(f"rows_{tag}"),
            n_unique(F.col("SSBS")).cast("long").alias(f"sites_{tag}"),
        )

    values = [counts(d, t) for d, t in ((a, "a"), (b, "b"))]
    first = counts(out, "out")

    def scalar(df: DataFrame, name: str) -> Column:
        return df.select(name).scalar()

    rows_in = scalar(values[0], "rows_a") + scalar(values[1], "rows_b")
    sites_in = scalar(values[0], "sites_a") + scalar(values[1], "sites_b")
    duplicates = duplicate_rows(out).scalar()
    return first.select(
        F.lit(columns_match).alias("columns_match"),
        duplicates.alias("n_duplicates"),
        (F.col("rows_out") - rows_in).alias("row_difference"),
        (F.col("sites_out") - sites_in).alias("site_difference"),
    )


def check_site_coordinates(df: DataFrame, crs: str = "EPSG:4326", expected_crs: str = "EPSG:4326") -> DataFrame:
    """Required columns, missing coordinates, repeated sites and the reference system."""
    missing = [c for c in ("SSBS", "Longitude", "Latitude") if c not in df.columns]
    if missing:
        raise ValueError(f"Required columns are missing: {missing}")
    return df.agg(
        F.count(F.lit(1)).alias("n_sites"),
        _count(any_of([is_invalid(col(c)) for c in ("Longitude", "Latitude")])).alias("missing_coordinates"),
        (F.count(F.lit(1)) - n_unique(F.col("SSBS"))).cast("long").alias("repeated_sites"),
        F.lit(crs == expected_crs).alias("crs_ok"),
    )


def check_beta_scores(df: DataFrame, score: str = "Bray_Curtis_score") -> DataFrame:
    """NaN scores (must be none) and null scores (both sites empty)."""
    return df.agg(
        _count(F.isnan(col(score))).alias("n_nan"), _count(col(score).isNull()).alias("n_null")
    )
