"""Model scope: counts, filters and their order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ecoframe.functions.nulls import all_of, col, n_unique
from ecoframe.operators.joins import apply_scope_manifest, distinct_scope
from ecoframe.operators.ranking import quantiles, quantiles_of_few_keys
from ecoframe.operators.sampling import sample_ids, sample_pairs_balanced
from ecoframe.operators.skew import attach
from ecoframe.operators.transforms import (
    drop_invalid_rows,
    filter_known_land_use,
    filter_scope,
    filter_taxonomic_scope,
)
from ecoframe.session import materialise


def scope_keys(diversity_type: str) -> list[str]:
    if diversity_type == "alpha":
        return ["SSBS"]
    if diversity_type == "beta":
        return ["SSBS", "Primary_minimal_site"]
    raise ValueError(f"Unsupported diversity_type: {diversity_type}")


def scope_counts(df: DataFrame, diversity_type: str, check_key: str | None = None) -> DataFrame:
    """Studies, observations and sites (or site pairs), optionally distinct check keys."""
    keys = scope_keys(diversity_type)
    name = "sites" if diversity_type == "alpha" else "site_pairs"
    exprs = [
        n_unique(F.col("SS")).alias("studies"),
        F.count(F.lit(1)).alias("observations"),
        n_unique(*[col(k) for k in keys]).alias(name),
    ]
    if check_key:
        exprs.append(n_unique(col(check_key)).alias("check_key"))
    return df.agg(*exprs)


def outlier_bounds(df: DataFrame, response: str, multiplier: float = 1.5) -> DataFrame:
    """Upper bound q3 + m * (q3 - q1) per study, with nearest-rank quartiles."""
    q = quantiles(df, ["SS"], response, {"q1": 0.25, "q3": 0.75}, "nearest")
    return q.select("SS", (F.col("q3") + multiplier * (F.col("q3") - F.col("q1"))).alias("upper"))


def filter_outliers_iqr(df: DataFrame, response: str, multiplier: float, keys: list[str]) -> DataFrame:
    """Keep the sites (or pairs) that have a row at or below the bound of their study."""
    bounded = attach(df, outlier_bounds(df, response, multiplier), ["SS"], null_safe=False)
    kept = distinct_scope(bounded.filter(col(response) <= F.col("upper")), keys)
    return df.join(kept, keys, "left_semi")


def repeated_pairs(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose site is in several studies; no other pair repeats if studies hold a pair once."""
    studies = df.select("SS", "SSBS").distinct().groupBy("SSBS").agg(F.count(F.lit(1)).alias("__n"))
    several = materialise(studies.filter("__n > 1").select("SSBS"), "several")
    return df.join(several, "SSBS", "left_semi").filter(all_of([col(k).isNotNull() for k in keys]))


def filter_outlier_pairs(df: DataFrame, response: str, multiplier: float, keys: list[str]) -> DataFrame:
    """:func:`filter_outliers_iqr` of a written table that holds a pair once per study.

    A pair is then kept for its own row, or for that of another study, which takes sites of several studies.
    """
    q = quantiles_of_few_keys(df, ["SS"], response, {"q1": 0.25, "q3": 0.75})
    bounds = materialise(q.select("SS", (F.col("q3") + multiplier * (F.col("q3") - F.col("q1"))).alias("upper")), "bounds")

    def within(rows: DataFrame) -> DataFrame:
        return attach(rows, bounds, ["SS"], null_safe=False).withColumn("__in", F.coalesce(col(response) <= F.col("upper"), F.lit(False)))

    named = all_of([col(k).isNotNull() for k in keys])
    own = within(df).filter(F.col("__in") & named)
    again = within(repeated_pairs(df, keys))
    kept = again.filter("__in").select(*[col(k) for k in keys]).distinct()
    columns = [col(c) for c in df.columns]
    return own.select(*columns).unionByName(again.filter("NOT __in").join(kept, keys, "left_semi").select(*columns))


def filter_small_studies(df: DataFrame, min_n: int) -> DataFrame:
    """Drop studies with fewer than ``min_n`` rows that name a site."""
    sizes = df.groupBy("SS").agg(F.count("SSBS").alias("n_sites"))
    small = sizes.filter(F.col("n_sites") < min_n).select("SS")
    return df.join(small, "SS", "left_anti")


def filter_few_reference_sites(df: DataFrame, min_n: int) -> DataFrame:
    """Keep studies with at least ``min_n`` distinct reference sites."""
    reference = df.filter(col("Primary vegetation_Minimal use") == 1)
    sizes = reference.groupBy("SS").agg(n_unique(F.col("SSBS")).alias("n_sites"))
    return df.join(sizes.filter(F.col("n_sites") >= min_n).select("SS"), "SS", "left_semi")


def scope_change_report(before: DataFrame, after: DataFrame, diversity_type: str) -> DataFrame:
    """Counts before and after a step, one row per quantity."""
    name = "sites" if diversity_type == "alpha" else "site_pairs"

    def long(df: DataFrame, tag: str) -> DataFrame:
        return scope_counts(df, diversity_type).unpivot(
            [], ["studies", "observations", name], "quantity", tag
        )

    return long(before, "before").join(long(after, "after"), "quantity").withColumn(
        "dropped", F.col("before") - F.col("after")
    )


@dataclass
class ScopeSettings:
    """Arguments of the filter chain, in the order the steps run."""

    diversity_type: str = "alpha"
    response: str = "Scaled_Geometric_mean_abundance"
    checked_columns: list[str] = field(default_factory=list)
    biogeographic: tuple[str, dict[str, list[str]]] | None = None
    taxonomic: tuple[str, str, dict[str, list[str]]] | None = None
    require_intensity: bool = True
    exclude_outliers: bool = True
    iqr_multiplier: float = 1.5
    min_sites_per_study: int = 0
    min_reference_sites: int = 0
    fraction: float = 1.0
    sample_level: str = "sites"
    k_min: int = 300
    k_max: int = 3000
    seed: int = 42
    # Every study holds a pair of sites once, as a similarity over all taxa does, and the table is a written one.
    pairs_once: bool = False


def filtered_scope(df_all: DataFrame, s: ScopeSettings) -> DataFrame:
    """The filter chain on all-species data."""
    keys = scope_keys(s.diversity_type)
    df = drop_invalid_rows(df_all, [s.response, *s.checked_columns])
    if s.biogeographic:
        df = filter_scope(df, *s.biogeographic)
    if s.taxonomic:
        df = filter_taxonomic_scope(df, *s.taxonomic)
    # Every later step reads its input more than once (statistics, then a semi join), so the two
    # results with the most work behind them are written once instead of recomputed.
    df = filter_known_land_use(df, s.require_intensity)
    if s.pairs_once:  # read again, not written again: nothing but filters lie before
        if s.exclude_outliers:
            df = filter_outlier_pairs(df, s.response, s.iqr_multiplier, keys)
    else:
        df = materialise(df, "scope")
    if s.exclude_outliers and not s.pairs_once:
        df = materialise(filter_outliers_iqr(df, s.response, s.iqr_multiplier, keys), "scope")
    if s.min_sites_per_study > 0:
        df = filter_small_studies(df, s.min_sites_per_study)
    if s.diversity_type == "beta" and s.min_reference_sites > 0:
        df = filter_few_reference_sites(df, s.min_reference_sites)
    if s.fraction < 1.0:
        if s.diversity_type == "alpha":
            df = sample_ids(df, s.sample_level, s.fraction, s.seed)
        else:
            n_pairs = None
            if s.pairs_once:
                again = repeated_pairs(df, keys)
                extra = again.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("__more")).agg(F.coalesce(F.sum("__more"), F.lit(0)))
                n_pairs = F.lit(df.count() - extra.first()[0])
            df = sample_pairs_balanced(df, s.fraction, s.k_min, s.k_max, s.seed, n_pairs=n_pairs)
    return df


def model_scope(df_all: DataFrame, df_scope: DataFrame | None, s: ScopeSettings) -> DataFrame:
    """Rows of the model table.

    The chain on all-species data gives the manifest of sites (or pairs). With a separate scope
    table its rows are reduced to the manifest and checked for invalid values; without one the
    all-species rows are reduced to what remains valid.
    """
    keys = scope_keys(s.diversity_type)
    filtered = materialise(filtered_scope(df_all, s), "scope")
    manifest = distinct_scope(filtered, keys)
    if df_scope is not None:
        return drop_invalid_rows(
            apply_scope_manifest(df_scope, manifest, keys), [s.response, *s.checked_columns]
        )
    final = distinct_scope(
        drop_invalid_rows(apply_scope_manifest(df_all, manifest, keys), [s.response, *s.checked_columns]),
        keys,
    )
    return apply_scope_manifest(filtered, final, keys)
