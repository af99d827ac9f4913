"""Evaluation of predictions and descriptive tables (2.4 A13-A16)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ecoframe import config
from ecoframe.functions.nulls import all_of, clamp, col, is_finite, n_unique, safe_div, sum_of
from ecoframe.functions.stats import (
    logit,
    r2_standard,
    r2_variance,
    safe_corr,
    student_t_quantile,
)
from ecoframe.operators.joins import harmonise_country, reference_condition
from ecoframe.operators.ranking import first_per_key, quantiles, rank_bins, rank_within, running_weight
from ecoframe.operators.neighbours import nearest_distances
from ecoframe.operators.skew import PAIR_BLOCK_ROWS, PAIRS_PER_TASK, attach, blocked_join, blocked_pairs
from ecoframe.session import materialise

# --- descriptive tables ---------------------------------------------------------------------


def frequency_table(df: DataFrame, group: str, metric: str, secondary: str | None = None) -> DataFrame:
    """Samples, sites or studies per group, largest first."""
    options = {
        "samples": F.count("SSBS"),
        "sites": n_unique(F.col("SSBS")).cast("long"),
        "studies": n_unique(F.col("SS")).cast("long"),
    }
    wanted = [m for m in (metric, secondary) if m]
    unknown = [m for m in wanted if m not in options]
    if unknown:
        raise ValueError(f"Unsupported count type: {unknown}")
    return (
        df.groupBy(col(group)).agg(*[options[m].alias(m) for m in wanted]).orderBy(F.desc(metric), col(group))
    )


def sites_per_study(df: DataFrame) -> DataFrame:
    return df.groupBy("SS").agg(n_unique(F.col("SSBS")).cast("long").alias("n_sites"))


def study_size_shares(sizes: DataFrame, cutoffs: tuple[int, ...] = (5, 25), subset: int = 200) -> DataFrame:
    """Share of studies up to each cutoff, and the number of studies in the plotted subset."""
    return sizes.agg(
        F.count(F.lit(1)).alias("n_studies"),
        *[F.avg(F.when(F.col("n_sites") <= c, 1.0).otherwise(0.0)).alias(f"share_up_to_{c}") for c in cutoffs],
        F.sum(F.when(F.col("n_sites") <= subset, 1).otherwise(0)).cast("long").alias(f"n_up_to_{subset}"),
    )


def histogram(df: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """Equal-width bins over the joint range of one or several columns; the last bin is closed.

    Every bin is listed, those without a value with n = 0.
    """
    ends = df.agg(
        F.struct(
            F.least(*[F.min(col(c)) for c in columns], F.lit(None)).alias("low"),
            F.greatest(*[F.max(col(c)) for c in columns], F.lit(None)).alias("high"),
        )
    ).scalar()
    low, high = ends["low"], ends["high"]
    entries = F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("double").alias("v")) for c in columns])
    values = df.select(F.explode(entries).alias("e")).select("e.*").filter(F.col("v").isNotNull())
    width = (high - low) / bins
    place = F.least(F.floor(safe_div(F.col("v") - low, width)), F.lit(bins - 1).cast("long"))
    counted = values.groupBy("column", F.coalesce(place, F.lit(0).cast("long")).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    every = df.sparkSession.range(bins).select(
        F.explode(F.array(*[F.lit(c) for c in columns])).alias("column"), F.col("id").cast("int").alias("bin")
    )
    return every.join(counted, ["column", "bin"], "left").select(
        "column", "bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"),
        (low + F.col("bin") * width).alias("bin_start"),
        (low + (F.col("bin") + 1) * width).alias("bin_end"),
    )


# --- metrics --------------------------------------------------------------------------------


def _quarters(df: DataFrame, column: str, tiebreak: list[str], keys: list[str]) -> DataFrame:
    """``rank_bins(df, column, 4, tiebreak, keys)``, sorting only the rows on which an edge of bins falls.

    Values are counted first. A value whose rows all lie in one bin gives them that bin; rows of the others
    (at most three values per key) are ranked among themselves and moved by the rows before the value.
    """
    at = [*keys, column]
    counts = df.groupBy(*[col(c) for c in at]).agg(F.count(F.lit(1)).alias("__w"))
    running = running_weight(counts, keys, [col(column)], "__w")

    def bin_of(rank: Column) -> Column:
        # ceil(4 * rn / n) - 1 for the 1-based rank rn, in integer arithmetic
        return F.floor((rank * 4 - 1) / F.col("__size")).cast("int")

    values = running.select(
        *[col(c) for c in at], F.col("before").alias("__under"), F.col("group_size").alias("__size"), "__w"
    ).withColumns({"__low": bin_of(F.col("__under") + 1), "__high": bin_of(F.col("__under") + F.col("__w"))})
    values = materialise(values, "values")
    placed = attach(df, values, at)
    whole = placed.filter("__low = __high").select(*[col(c) for c in df.columns], F.col("__low").alias("bin"))
    edges = placed.filter("__low <> __high").select(*[col(c) for c in df.columns], "__under", "__size")
    ranked = rank_within(edges, at, [col(t) for t in tiebreak])
    return whole.unionByName(ranked.select(*[col(c) for c in df.columns], bin_of(F.col("__under") + F.col("position") + 1).alias("bin")))


def _segments(df: DataFrame, observed: str, tiebreak: list[str], keys: list[str]) -> DataFrame:
    """Rows labelled "overall" and, for the outer quarters by rank, "bottom" or "top"."""
    quarter = _quarters(df, observed, tiebreak, keys)
    names = F.array_compact(
        F.array(
            F.lit("overall"),
            F.when(F.col("bin") == 0, F.lit("bottom")).when(F.col("bin") == 3, F.lit("top")),
        )
    )
    return quarter.withColumn("segment", F.explode(names)).drop("bin")


def weighted_average_rank(counts: DataFrame, keys: list[str], column: str, weight: str, name: str) -> DataFrame:
    """Tie-averaged rank of ``column`` in a table whose rows stand for ``weight`` rows each."""
    totals = counts.groupBy(*[col(c) for c in [*keys, column]]).agg(F.sum(weight).alias("__tie"))
    running = running_weight(totals, keys, [col(column)], "__tie")
    ranks = running.select(*[col(c) for c in [*keys, column]], (F.col("before") + (F.col("__tie") + 1) / 2).alias(name))
    return attach(counts, ranks, [*keys, column])


def spearman(df: DataFrame, keys: list[str], x: str, y: str, name: str = "spearman_corr") -> DataFrame:
    """Rank correlation of complete pairs: equal pairs are counted first, then ranked and weighted."""
    if not keys:
        return spearman(df.withColumn("__all", F.lit(1)), ["__all"], x, y, name).drop("__all")
    counts = materialise(
        df.filter(col(x).isNotNull() & col(y).isNotNull())
        .groupBy(*[col(k) for k in keys], col(x), col(y))
        .agg(F.count(F.lit(1)).alias("__w")),
        "pairs",
    )
    both = weighted_average_rank(weighted_average_rank(counts, keys, x, "__w", "__rx"), keys, y, "__w", "__ry")
    w, a, b = F.col("__w"), F.col("__rx"), F.col("__ry")
    # Both mean ranks are (n + 1) / 2.
    n = both.groupBy(*[col(k) for k in keys]).agg(((F.sum(w) + 1) / 2).alias("__m"))
    centred = attach(both, n, keys)
    a, b = a - F.col("__m"), b - F.col("__m")
    sums = centred.groupBy(*[col(k) for k in keys]).agg(
        F.sum(w * a * b).alias("__ab"), F.sum(w * a * a).alias("__aa"), F.sum(w * b * b).alias("__bb")
    )
    value = F.when((F.col("__aa") > 0) & (F.col("__bb") > 0), F.col("__ab") / F.sqrt(F.col("__aa") * F.col("__bb")))
    return sums.select(*[col(k) for k in keys], value.alias(name))


def performance_metrics(
    pred: DataFrame,
    tiebreak: list[str],
    predicted: str = "Predicted",
    observed: str = "Observed",
    spread: str | None = None,
    keys: list[str] | None = None,
) -> DataFrame:
    """Accuracy of predictions overall and in the outer quarters of the observed values.

    ``spread`` names the random-effect prediction whose variance enters r2_var in place of the
    prediction's own (mixed models under cross-validation). With ``keys`` (for example fold and
    role) everything is computed per key in the same plan.
    """
    keys = keys or []
    cols = list(dict.fromkeys([*keys, *tiebreak, observed, predicted, *([spread] if spread else [])]))
    rows = _segments(pred.select(*[col(c) for c in cols]), observed, tiebreak, keys)
    rows = rows.withColumn("__err", F.abs(col(observed) - col(predicted)))
    by = [*keys, "segment"]
    y, p = col(observed), col(predicted)
    basic = rows.groupBy(*[col(k) for k in by]).agg(
        F.count(F.lit(1)).alias("n"),
        r2_standard(y, p).alias("r2_std"),
        r2_variance(y, p, col(spread) if spread else None).alias("r2_var"),
        F.avg("__err").alias("mean_abs_error"),
        safe_corr(y, p).alias("pearson_corr"),
        bias_ratio(y, p).alias("bias_ratio"),
    )
    median = quantiles(rows, by, "__err", {"median_abs_error": 0.5}, "linear")
    ranks = spearman(rows, by, observed, predicted)
    return attach(attach(basic, median, by), ranks, by)


def bias_ratio(y: Column, p: Column) -> Column:
    """mean(predicted) / mean(observed); null where the observed mean is practically 0."""
    mean = F.avg(y)
    return F.when(F.abs(mean) > 1e-8, safe_div(F.avg(p), mean))


def bias_ratios(
    pred: DataFrame, tiebreak: list[str], predicted: str = "Predicted", observed: str = "Observed", keys: list[str] | None = None
) -> DataFrame:
    """Bias overall, in the outer quarters and per tenth of the observed values.

    All sections are listed; one without rows has n = 0 and no bias. With ``keys`` (for example
    model and mode) the sections are those of each key, all in one plan.
    """
    keys = keys or []
    base = pred.select(*[col(c) for c in dict.fromkeys([*keys, *tiebreak, observed, predicted])])
    tenths = rank_bins(base, observed, 10, tiebreak, keys).withColumnRenamed("bin", "__tenth")
    rows = rank_bins(tenths, observed, 4, tiebreak, keys).withColumn(
        "section",
        F.explode(
            F.array_compact(
                F.array(
                    F.lit("overall"),
                    F.when(F.col("bin") == 0, F.lit("bottom_quartile")).when(
                        F.col("bin") == 3, F.lit("top_quartile")
                    ),
                    F.concat(F.lit("decile_"), (F.col("__tenth") + 1).cast("string")),
                )
            )
        ),
    )
    counted = rows.groupBy(*[col(k) for k in keys], "section").agg(
        F.count(F.lit(1)).alias("n"), bias_ratio(col(observed), col(predicted)).alias("bias_ratio")
    )
    names = ["overall", "bottom_quartile", "top_quartile", *[f"decile_{i}" for i in range(1, 11)]]
    sections = F.explode(F.array(*[F.lit(x) for x in names])).alias("section")
    if keys:
        every = base.select(*[col(k) for k in keys]).distinct().select(*[col(k) for k in keys], sections)
    else:
        every = pred.sparkSession.range(1).select(sections)
    return attach(every, counted, [*keys, "section"]).select(
        *[col(k) for k in keys], "section", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "bias_ratio"
    )


METRICS = [
    "r2_std", "r2_var", "mean_abs_error", "median_abs_error", "pearson_corr", "spearman_corr", "bias_ratio",
]


def cv_summary(metrics: DataFrame) -> DataFrame:
    """Mean, minimum and maximum over folds per role, segment and metric."""
    names = [m for m in METRICS if m in metrics.columns]
    long = metrics.unpivot(["role", "segment"], names, "metric", "value")
    return long.groupBy("role", "segment", "metric").agg(
        F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max")
    )


def safe_correlation(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*[col(k) for k in keys]).agg(safe_corr(col(x), col(y)).alias("pearson_r"))


def model_performance_table(pred: DataFrame, observed: str = "Observed", predicted: str = "Predicted") -> DataFrame:
    """Correlation per (model, mode); for cross-validation also over folds."""
    overall = pred.groupBy("model", "mode").agg(safe_corr(col(observed), col(predicted)).alias("Mean"))
    cv = pred.filter(~F.lower("mode").contains("training") & F.col("fold").isNotNull())
    per_fold = cv.groupBy("model", "mode", "fold").agg(
        safe_corr(col(observed), col(predicted)).alias("r")
    )
    ends = per_fold.groupBy("model", "mode").agg(
        F.min("r").alias("Min"),
        F.max("r").alias("Max"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("fold", "r")))).alias("r_fold"),
    )
    return overall.join(ends, ["model", "mode"], "left")


def fold_correlations(pred: DataFrame, observed: str = "Observed", predicted: str = "Predicted") -> DataFrame:
    """The per-fold correlations of ``model_performance_table`` in long form."""
    cv = pred.filter(~F.lower("mode").contains("training") & F.col("fold").isNotNull())
    return cv.groupBy("model", "mode", "fold").agg(safe_corr(col(observed), col(predicted)).alias("r"))


# --- pairs ----------------------------------------------------------------------------------


def delta_predictions(
    pred: DataFrame,
    info: DataFrame,
    level: str,
    predicted: str,
    ref_only: bool = False,
    taxon: str | None = None,
    keys: list[str] | None = None,
) -> DataFrame:
    """Differences between the sites of a study or block, each pair once (per taxon and key).

    The pair list is the result itself. Sites with more than one row (per taxon) are left out.
    ``ref_only`` compares baseline sites, always listed first, with the others. Large groups are
    spread over cells.
    """
    join_cols = [level, "Predominant_land_use", "Use_intensity"]
    sites = first_per_key(info.select("SSBS", *join_cols), ["SSBS"], join_cols)
    merged = pred.join(sites, "SSBS", "left")
    unit = [*(keys or []), level, *([taxon] if taxon else [])]
    per_site = merged.groupBy(*[col(u) for u in unit], "SSBS").agg(
        F.count(F.lit(1)).alias("__n"),
        F.max("Observed").alias("__o"),
        F.max(col(predicted)).alias("__p"),
        F.max("Predominant_land_use").alias("__lu"),
        F.max("Use_intensity").alias("__ui"),
        F.coalesce(F.bool_or(reference_condition()), F.lit(False)).alias("__ref"),
    )
    single = materialise(per_site.filter(F.col("__n") == 1).drop("__n"), "sites")

    sited = single.select(
        *[col(u) for u in unit], F.col("SSBS").alias("site"), F.col("__o").alias("o"), F.col("__p").alias("p"),
        F.col("__lu").alias("lu"), F.col("__ui").alias("ui"), *(["__ref"] if ref_only else []),
    )
    own = ["site", "o", "p", "lu", "ui"]
    if ref_only:
        one, two = (
            sited.filter(kept).select(*[col(u) for u in unit], *[F.col(c).alias(f"{c}_{n}") for c in own])
            for n, kept in ((1, F.col("__ref")), (2, ~F.col("__ref")))
        )
        pairs = blocked_join(one, two, unit, ["site_1"], ["site_2"], PAIR_BLOCK_ROWS, PAIRS_PER_TASK)
    else:
        pairs = blocked_pairs(sited, unit, "site", PAIRS_PER_TASK)
    d_obs, d_pred = F.col("o_2") - F.col("o_1"), F.col("p_2") - F.col("p_1")
    return pairs.select(
        *[col(u) for u in unit], "site_1", "site_2",
        d_obs.alias("Observed"), d_pred.alias(predicted), (d_pred - d_obs).alias("residual"),
        "lu_1", "ui_1", "lu_2", "ui_2",
    )


# --- variance and calibration ---------------------------------------------------------------


def variance_explained(
    pred: DataFrame, distribution: str, phi: float | None = None, eps: float = config.EPSILON, keys: list[str] | None = None
) -> DataFrame:
    """Marginal and conditional R2 of a mixed model."""
    y, fe, re = F.col("Observed"), F.col("Predicted_FE"), F.col("Predicted_RE")
    if distribution == "gaussian":
        v_fe, v_re, v_res = F.var_samp(fe), F.var_samp(re - fe), F.var_samp(y - re)
    elif distribution == "beta":
        mu_fe, mu_re = clamp(fe, eps, 1 - eps), clamp(re, eps, 1 - eps)
        v_fe, v_re = F.var_samp(logit(mu_fe)), F.var_samp(logit(mu_re) - logit(mu_fe))
        v_res = F.avg(1 / ((1 + float(phi)) * mu_re * (1 - mu_re)))
    else:
        raise ValueError(f"Unsupported distribution: {distribution}")
    total = v_fe + v_re + v_res
    return pred.groupBy(*(keys or [])).agg(
        safe_div(v_fe, total).alias("marginal_r2"), safe_div(v_fe + v_re, total).alias("conditional_r2")
    )


def bayesian_r2(draws_pred: DataFrame, observed: str = "Observed", predicted: str = "Prediction") -> DataFrame:
    """Variance explained per posterior draw."""
    y, p = col(observed), col(predicted)
    return draws_pred.groupBy("Chain", "Draw").agg(r2_variance(y, p).alias("bayesian_r2"))


def calibration_by_group(
    pred: DataFrame, group: str, observed: str = "Observed", predicted: str = "Predicted", keys: list[str] | None = None
) -> DataFrame:
    """Fit per group (and key), largest group first."""
    by = [col(c) for c in [*(keys or []), group]]
    y, p = col(observed), col(predicted)
    return (
        pred.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            r2_standard(y, p).alias("r2_std"),
            r2_variance(y, p).alias("r2_var"),
            F.avg(p - y).alias("mean_residual"),
            F.stddev_pop(p - y).alias("sd_residual"),
        )
        .orderBy(F.desc("n"), *by)
    )


# --- groups ---------------------------------------------------------------------------------


def outlier_share(df: DataFrame, group: str, column: str, keys: list[str] | None = None) -> DataFrame:
    """Share and number of rows outside the quartiles by more than 1 and 1.5 ranges."""
    by = [*(keys or []), group]
    q = quantiles(df, by, column, {"q1": 0.25, "q3": 0.75}, "nearest")
    joined = attach(df.select(*[col(c) for c in [*by, column]]), q, by)
    iqr = F.col("q3") - F.col("q1")

    def flag(m: float) -> Column:
        outside = (col(column) < F.col("q1") - m * iqr) | (col(column) > F.col("q3") + m * iqr)
        return F.when(outside, 1).when(~outside, 0)

    return joined.groupBy(*[col(c) for c in by]).agg(
        F.avg(flag(1.5)).alias("prop_outliers_1_5"),
        F.sum(flag(1.5)).cast("long").alias("n_outliers_1_5"),
        F.avg(flag(1.0)).alias("prop_outliers_1"),
        F.sum(flag(1.0)).cast("long").alias("n_outliers_1"),
    )


def taxa_per_group(obs: DataFrame, pred: DataFrame, group: str) -> DataFrame:
    """Distinct orders, families, genera and species per group of sites."""
    groups = pred.select("SSBS", col(group)).distinct()
    taxa = obs.select("SSBS", "Order", "Family", "Genus", "Species").distinct()
    joined = taxa.join(groups, "SSBS", "left")
    names = {"Order": "n_orders", "Family": "n_families", "Genus": "n_genera", "Species": "n_species"}
    return joined.groupBy(col(group)).agg(
        *[n_unique(F.col(c)).cast("long").alias(n) for c, n in names.items()]
    )


def group_summary(
    joined: DataFrame,
    gower: DataFrame,
    obs: DataFrame,
    group: str,
    observed: str = "Observed",
    predicted: str = "Predicted",
) -> DataFrame:
    """Everything known about a group: size, spread, accuracy, outliers, homogeneity, taxa."""
    data = joined
    if group == "Final_hierarchical_group":
        data = joined.filter(F.col("Final_hierarchical_level") != "Population")
    stats = data.groupBy(col(group)).agg(
        n_unique(F.col("SSBS")).cast("long").alias("n_sites"),
        F.count(F.lit(1)).alias("n_observations"),
        n_unique(F.col("SS")).cast("long").alias("n_studies"),
        F.stddev_samp(col(observed)).alias("response_std"),
        safe_corr(col(observed), col(predicted)).alias("Pearson_r"),
    )
    stats = stats.select(
        "*", *[F.ln(n).alias(f"{n}_log") for n in ("n_sites", "n_observations", "n_studies")]
    )
    out = attach(stats, outlier_share(data, group, observed), [group], null_safe=False)
    out = attach(out, gower, [group], null_safe=False)
    return attach(out, taxa_per_group(obs, data, group), [group], null_safe=False)


def country_stats(
    pred: DataFrame,
    observed: str = "Observed",
    predicted: str = "Predicted",
    clip: tuple[float, float] | None = None,
    keys: list[str] | None = None,
    lookup: DataFrame | None = None,
) -> DataFrame:
    """Studies, sites and accuracy per country (and key), largest first.

    With a ``lookup`` (country_std, iso_a3) names are harmonised and ISO codes added.
    """
    by = [*(keys or []), "Country"]
    r = safe_corr(col(observed), col(predicted))
    if clip:
        r = clamp(r, clip[0], clip[1])
    stats = (
        pred.groupBy(*[col(c) for c in by])
        .agg(
            n_unique(F.col("SS")).cast("int").alias("Nb_of_studies"),
            n_unique(F.col("SSBS")).cast("int").alias("Nb_of_sites"),
            r.alias("Average_r"),
        )
    )
    if lookup is not None:
        stats = harmonise_country(stats, lookup)
    return stats.orderBy(F.desc("Nb_of_sites"), *[col(c) for c in by])


def country_filter_percentiles(
    stats: DataFrame, value: str = "Average_r", min_sites: int = 25, min_studies: int = 2
) -> DataFrame:
    """5th and 95th percentile of the values of well-covered countries."""
    kept = stats.filter((F.col("Nb_of_sites") >= min_sites) & (F.col("Nb_of_studies") >= min_studies))
    return quantiles(kept, [], value, {"perc_5": 0.05, "perc_95": 0.95}, "linear")


def intactness(pred: DataFrame, info: DataFrame, min_n: int = 5, keys: list[str] | None = None) -> DataFrame:
    """Predictions and observations relative to the reference sites of the study.

    With ``keys`` the observed reference means are those of each key.
    """
    by = [*(keys or []), "SS"]
    reference = info.filter(reference_condition())
    enough = reference.groupBy("SS").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= min_n)
    data = pred.join(
        info.select("SSBS", "SS", "Predominant_land_use", "Use_intensity"), "SSBS", "left"
    ).join(enough.select("SS"), "SS", "left_semi")
    if "Predicted_FE" in data.columns:
        data = data.withColumnsRenamed({"Predicted_FE": "Predicted", "Reference_pred_FE": "Reference_pred"})
    means = data.filter(reference_condition()).groupBy(*[col(c) for c in by]).agg(F.avg("Observed").alias("Observed_ref_mean"))
    data = attach(data, means, by, null_safe=False)

    def ratio(a: str, b: str, top: float) -> Column:
        x, y = F.col(a), F.col(b)
        return F.when((x == 0) | (y == 0), F.lit(0.0)).otherwise(clamp(safe_div(x, y), 0.0, top))

    out = data.select(
        "*",
        ratio("Predicted", "Reference_pred", 3.0).alias("Predicted_scaled"),
        ratio("Observed", "Observed_ref_mean", 3.0).alias("Observed_scaled"),
        ratio("Predicted", "Reference_pred", 1.0).alias("Predicted_scaled_capped"),
    )
    # Null comes from a missing side and stays, as only NaN and infinity are dropped.
    scaled = ["Predicted_scaled", "Observed_scaled", "Predicted_scaled_capped"]
    return out.filter(
        all_of([F.col(c).isNull() | is_finite(F.col(c)) for c in scaled])
    )


# --- covariate distances --------------------------------------------------------------------


def _ranges(df: DataFrame, columns: list[str]) -> list[Column]:
    return [
        _width(F.min(col(c).cast("double")), F.max(col(c).cast("double"))).alias(c) for c in columns
    ]


def _width(low: Column, high: Column) -> Column:
    """Range used for scaling; a column whose maximum is exactly 0 does not count."""
    return F.when(high == 0, F.lit(0.0)).otherwise(high - low)


def _gower_terms(a, b, width, columns: list[str]) -> Column:
    """Mean of range-scaled absolute differences; a constant column contributes 0."""
    terms = [F.coalesce(safe_div(F.abs(a(c) - b(c)), width(c)), F.lit(0.0)) for c in columns]
    return sum_of(terms) / len(columns)


def _middle(values: Column, metric: str) -> Column:
    n = F.size(values)
    if metric == "mean":
        return safe_div(F.aggregate(values, F.lit(0.0), lambda s, v: s + v), n)
    if metric != "median":
        raise ValueError(f"Unsupported metric: {metric}")
    low = F.get(values, F.floor((n - 1) / 2).cast("int"))
    high = F.get(values, F.floor(n / 2).cast("int"))
    return (low + high) / 2


def _points(df: DataFrame, group: Column, id_col: str, coordinates: list[Column]) -> DataFrame:
    return df.select(group.alias("group"), F.col("__row").alias("row"), col(id_col).cast("string").alias("id"), F.array(*coordinates).alias("point"))


def _numbered(df: DataFrame) -> DataFrame:
    """``df`` with a row number, written so that it stays the same in every later step."""
    return materialise(df.withColumn("__row", F.monotonically_increasing_id()), "rows")


def _scaled(x: Column, width: Column) -> Column:
    """A coordinate in units of its range; a column without range makes no difference."""
    return F.when(width > 0, x.cast("double") / width).when(x.isNotNull(), F.lit(0.0))


def gower_knn(
    query: DataFrame,
    reference: DataFrame,
    columns: list[str],
    id_col: str,
    k: int = 5,
    max_ref: int | None = None,
    metric: str = "median",
    selection: str = "nearest",
    seed: int = 42,
    same: bool = False,
) -> DataFrame:
    """Middle of the Gower distances of every query row to its k nearest reference rows.

    All reference rows are searched, unless ``max_ref`` asks for the first so many in hash order.
    ``selection="random"`` takes the first k in hash order instead of the nearest. With ``same``
    a row is not its own neighbour. Ranges are those of query and used references together.
    """
    from ecoframe.operators.ranking import rank_within
    from ecoframe.operators.sampling import hash_order

    if selection not in ("nearest", "random"):
        raise ValueError(f"Unsupported selection: {selection}")
    if selection == "random" and not same:
        raise ValueError("Random selection is defined among the rows of one table: same=True")
    # One more than k, as a row's own point does not count with ``same``.
    wanted = k + 1 if selection == "random" else max_ref
    picks = reference.select(col(id_col), *[col(c) for c in columns])
    if max_ref is not None or selection == "random":
        hashed = picks.withColumn("__h", hash_order(seed, col(id_col)))
        limit = min(x for x in (max_ref, wanted) if x is not None)
        picks = rank_within(hashed, [], [F.col("__h"), col(id_col)]).filter(F.col("position") < limit)
    picks, asked = _numbered(picks), _numbered(query)
    both = asked.select(*[col(c) for c in columns]).unionByName(picks.select(*[col(c) for c in columns]))
    width = both.agg(*_ranges(both, columns)).first()  # one row of numbers
    xs = [_scaled(col(c), F.lit(width[c]).cast("double")) for c in columns]
    near = nearest_distances(_points(asked, F.lit(""), id_col, xs), _points(picks, F.lit(""), id_col, xs), k, same)
    scored = asked.join(near.withColumnRenamed("row", "__row"), "__row", "left")
    return scored.select(*[col(c) for c in query.columns], _middle(F.col("nearest"), metric).alias("gower_distance"))


def gower_knn_exact(
    df: DataFrame, group: list[str], columns: list[str], id_col: str, k: int = 10, metric: str = "median"
) -> DataFrame:
    """Middle of the k smallest Gower distances of every row to other rows of its group.

    Exact; work is the square of a group's size, spread over tiles and blocks of bounded size
    (see ``neighbours``). Use ``gower_per_group(selection="random")`` where that is too much.
    """
    ends = df.groupBy(*[col(g) for g in group]).agg(
        *[F.min(col(c).cast("double")).alias(f"__lo{i}") for i, c in enumerate(columns)],
        *[F.max(col(c).cast("double")).alias(f"__hi{i}") for i, c in enumerate(columns)],
    )
    rows = _numbered(attach(df.select(*[col(g) for g in group], col(id_col), *[col(c) for c in columns]), ends, group))
    xs = [
        F.coalesce(safe_div(col(c).cast("double") - F.col(f"__lo{i}"), _width(F.col(f"__lo{i}"), F.col(f"__hi{i}"))), F.lit(0.0))
        for i, c in enumerate(columns)
    ]
    points = _points(rows, F.to_json(F.struct(*[col(g) for g in group])), id_col, xs)
    near = nearest_distances(points, points, k, True)
    return rows.join(near.withColumnRenamed("row", "__row"), "__row", "left").select(
        *[col(g) for g in group], col(id_col),
        F.when(F.size("nearest") > 0, _middle(F.col("nearest"), metric)).alias("gower_distance"),
    )


def gower_random(
    df: DataFrame, group: list[str], columns: list[str], id_col: str, k: int = 10, metric: str = "median", seed: int = 42
) -> DataFrame:
    """As ``gower_knn_exact``, but to k rows of the group drawn by hash order: linear work."""
    from ecoframe.operators.sampling import hash_order

    names = [col(g) for g in group]
    ends = df.groupBy(*names).agg(F.struct(*_ranges(df, columns)).alias("__width"))
    rows = df.select(*names, col(id_col), *[col(c) for c in columns])
    hashed = rows.withColumn("__h", hash_order(seed, col(id_col)))
    # k + 1 rows per group, as a drawn row is not compared with itself. Spark applies the limit before the
    # shuffle as well, so of each task k + 1 rows per group are ranked, not the group.
    by_hash = Window.partitionBy(*names).orderBy("__h", col(id_col))
    drawn = hashed.withColumn("position", F.row_number().over(by_hash)).filter(F.col("position") <= k + 1)
    point = F.struct("position", col(id_col).alias("id"), *[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    drawn = drawn.groupBy(*names).agg(F.sort_array(F.collect_list(point)).alias("__drawn"))
    joined = attach(attach(rows, ends, group), drawn, group)
    others = F.slice(F.filter("__drawn", lambda r: r["id"] != col(id_col)), 1, k)
    place = {c: i for i, c in enumerate(columns)}
    distances = F.transform(
        others,
        lambda r: _gower_terms(lambda c: col(c).cast("double"), lambda c: r[f"x{place[c]}"], lambda c: F.col("__width")[c], columns),
    )
    nearest = F.array_sort(distances)
    return joined.select(*names, col(id_col), F.when(F.size(nearest) > 0, _middle(nearest, metric)).alias("gower_distance"))


def gower_per_group(
    df: DataFrame,
    group: str,
    columns: list[str],
    id_col: str,
    k: int = 10,
    metric: str = "median",
    selection: str = "nearest",
    seed: int = 42,
) -> DataFrame:
    """Homogeneity of a group: mean, median and spread of the distances of its rows to k others,
    the nearest or (``selection="random"``) k drawn ones."""
    if selection == "nearest":
        knn = gower_knn_exact(df, [group], columns, id_col, k, metric)
    elif selection == "random":
        # Read for the means and again for the medians.
        knn = materialise(gower_random(df, [group], columns, id_col, k, metric, seed), "distances")
    else:
        raise ValueError(f"Unsupported selection: {selection}")
    stats = knn.groupBy(col(group)).agg(
        F.avg("gower_distance").alias("gower_mean"), F.stddev_pop("gower_distance").alias("gower_std")
    )
    medians = quantiles(knn, [group], "gower_distance", {"gower_median": 0.5}, "linear")
    return attach(stats, medians, [group])


def gower_train_test(
    df: DataFrame, columns: list[str], id_col: str, k_folds: int, k: int = 5, max_ref: int | None = None, seed: int = 42
) -> DataFrame:
    """Per fold: distances of training rows and of test rows to the training set.

    All training rows are searched, unless ``max_ref`` asks for the first so many in hash order,
    the same order in every fold; ranges are those of query and reference together, per fold
    and role.
    """
    from ecoframe.operators.folds import with_roles
    from ecoframe.operators.ranking import rank_within
    from ecoframe.operators.sampling import hash_order

    base = df.select(col(id_col).alias("id"), "Fold_id", *[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    xs = [f"x{i}" for i in range(len(columns))]
    rows = _numbered(with_roles(base, k_folds))
    picks = rows.filter(F.col("role") == "train")
    if max_ref is not None:
        hashed = picks.withColumn("__h", hash_order(seed, F.col("id")))
        picks = rank_within(hashed, ["fold"], [F.col("__h"), F.col("id")]).filter(F.col("position") < max_ref)
    low_high = [f(x).alias(f"__{n}_{x}") for n, f in (("lo", F.min), ("hi", F.max)) for x in xs]
    used = picks.groupBy("fold").agg(*low_high)
    asked = rows.groupBy("fold", "role").agg(*[e for e in low_high])
    asked = asked.toDF("fold", "role", *[f"q{c}" for c in asked.columns[2:]])
    width = asked.join(used, "fold").select(
        "fold", "role",
        F.struct(*[_width(F.least(f"q__lo_{x}", f"__lo_{x}"), F.greatest(f"q__hi_{x}", f"__hi_{x}")).alias(x) for x in xs]).alias("width"),
    )
    # 2 * k_folds rows.
    scaled = rows.join(F.broadcast(width), ["fold", "role"])
    refs = picks.drop("role").join(F.broadcast(width), "fold")
    group = F.concat_ws(":", F.col("fold").cast("string"), "role")
    coordinates = [_scaled(F.col(x), F.col("width")[x]) for x in xs]
    near = nearest_distances(_points(scaled, group, "id", coordinates), _points(refs, group, "id", coordinates), k, True)
    return scaled.join(near.withColumnRenamed("row", "__row"), "__row", "left").select(
        "fold", "role", F.col("id").alias(id_col), _middle(F.col("nearest"), "median").alias("gower_distance")
    )


# --- regressions and densities --------------------------------------------------------------


def ols_standardised(df: DataFrame, y: str, xs: list[str], alpha: float = 0.05) -> DataFrame:
    """Least squares on z-scored predictors, with t-based intervals and a significance mark.

    All cross products come from one aggregate; the solve is on a (p+1) x (p+1) matrix.
    """
    used = df.filter(all_of([is_finite(col(c)) for c in [y, *xs]]))
    p = len(xs)
    exprs = [F.count(F.lit(1)).alias("n"), F.avg(col(y)).alias("my"), F.var_samp(col(y)).alias("vy")]
    for i, a in enumerate(xs):
        exprs += [
            F.avg(col(a)).alias(f"m{i}"), F.stddev_samp(col(a)).alias(f"s{i}"),
            F.covar_samp(col(a), col(y)).alias(f"cy{i}"),
        ]
        exprs += [F.covar_samp(col(a), col(xs[j])).alias(f"c{i}_{j}") for j in range(i)]
    row = used.agg(*exprs).first()
    n, sd = row["n"], [row[f"s{i}"] for i in range(p)]
    if n < p + 2:
        raise ValueError(f"{n} finite rows are too few for {p} predictors")
    flat = [x for x, s in zip(xs, sd) if not s]
    if flat:
        raise ValueError(f"Predictors without spread: {flat}")
    corr = np.eye(p)
    for i in range(p):
        for j in range(i):
            corr[i, j] = corr[j, i] = row[f"c{i}_{j}"] / (sd[i] * sd[j])
    rhs = np.array([row[f"cy{i}"] / sd[i] for i in range(p)])
    slopes = np.linalg.solve(corr, rhs)
    rss = (n - 1) * (row["vy"] - float(slopes @ rhs))
    dof = n - p - 1
    sigma2 = rss / dof
    se = np.sqrt(np.diag(np.linalg.inv(corr)) * sigma2 / (n - 1))
    t = student_t_quantile(1 - alpha / 2, dof)
    rows = [("Intercept", float(row["my"]), math.sqrt(sigma2 / n))]
    rows += [(x, float(b), float(s)) for x, b, s in zip(xs, slopes, se)]
    out = [(x, b, s, b - t * s, b + t * s, "*" if b - t * s > 0 or b + t * s < 0 else "") for x, b, s in rows]
    schema = "term string, estimate double, std_error double, ci_lower double, ci_upper double, significant string"
    return df.sparkSession.createDataFrame(out, schema).orderBy("estimate")


def polyfit(df: DataFrame, x: str, y: str, degree: int = 3, points: int = 200) -> DataFrame:
    """Least-squares polynomial on finite rows: its values on an even grid over the x range.

    Power sums come from one aggregate on centred and scaled x, so high powers stay accurate.
    """
    used = df.filter(is_finite(col(x)) & is_finite(col(y)))
    ends = used.agg(F.min(col(x)).alias("lo"), F.max(col(x)).alias("hi")).first()
    if ends["lo"] is None:
        raise ValueError(f"No finite rows of {x} and {y}")
    lo, hi = float(ends["lo"]), float(ends["hi"])
    mid, half = (lo + hi) / 2, (hi - lo) / 2 or 1.0
    z = (col(x) - mid) / half
    powers = [F.sum(F.pow(z, F.lit(float(i)))).alias(f"p{i}") for i in range(2 * degree + 1)]
    moments = [F.sum(F.pow(z, F.lit(float(i))) * col(y)).alias(f"q{i}") for i in range(degree + 1)]
    extra = [safe_corr(col(x), col(y)).alias("r"), F.avg(F.abs(col(x) - col(y))).alias("mae")]
    row = used.agg(*powers, *moments, *extra).first()
    lhs = np.array([[row[f"p{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
    rhs = np.array([row[f"q{i}"] for i in range(degree + 1)])
    c = [float(v) for v in np.linalg.lstsq(lhs, rhs, rcond=None)[0]]
    grid = used.sparkSession.range(points).select(
        F.col("id").cast("int").alias("i"),
        (F.lit(lo) + F.col("id") * ((hi - lo) / (points - 1))).alias("x"),
    )
    zg = (F.col("x") - mid) / half
    value = F.lit(0.0)
    for coefficient in reversed(c):
        value = value * zg + coefficient
    return grid.select(
        "i", "x", value.alias("y"), F.lit(row["r"]).cast("double").alias("pearson_r"),
        F.lit(float(row["mae"])).alias("mae"),
    )


def kde_by_fold(
    df: DataFrame, column: str, k_folds: int, points: int = 200, adjust: float = 1.2, padding: float = 0.05
) -> DataFrame:
    """Gaussian density of training and test values per fold on one shared grid.

    Bandwidth n^(-1/5) * sd (sample) * ``adjust``; the density is null where the spread is zero or
    unknown. Equal values are counted first; each distinct value then adds to ``points`` sums per
    fold in one aggregate, so no row is repeated per grid point.
    """
    counts = materialise(
        df.filter(is_finite(col(column))).groupBy("Fold_id", col(column).cast("double").alias("v")).agg(
            F.count(F.lit(1)).alias("w")
        ),
        "kde",
    )
    means = counts.groupBy("Fold_id").agg(
        F.sum("w").cast("double").alias("n"), (F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("m"),
        F.min("v").alias("lo"), F.max("v").alias("hi"),
    )
    # Squares around each fold's own mean, so that a large mean does not cancel them out.
    centred = attach(counts, means.select("Fold_id", "m"), ["Fold_id"])
    squares = centred.groupBy("Fold_id").agg(F.sum(F.col("w") * F.pow(F.col("v") - F.col("m"), F.lit(2.0))).alias("ss"))
    by_fold = attach(means, squares, ["Fold_id"])
    ends = by_fold.agg(F.struct(F.min("lo").alias("lo"), F.max("hi").alias("hi"))).scalar()
    sized = by_fold.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k_folds - 1)))).withColumn(
        "role", F.when(F.col("fold") == F.col("Fold_id"), F.lit("test")).otherwise(F.lit("train"))
    )
    joint = sized.groupBy("fold", "role").agg(
        F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean")
    )
    # Parts are merged by their spread and the distance of their means; at most k_folds per row.
    parts = sized.join(F.broadcast(joint), ["fold", "role"])
    bands = parts.groupBy("fold", "role").agg(
        F.first("total").alias("n"),
        F.sum(F.col("ss") + F.col("n") * F.pow(F.col("m") - F.col("mean"), F.lit(2.0))).alias("ss"),
    )
    variance = safe_div(F.col("ss"), F.col("n") - 1)
    width = F.pow("n", F.lit(-0.2)) * F.sqrt(variance) * adjust
    bands = bands.select("fold", "role", "n", F.when(width > 0, width).alias("h"))
    values = counts.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k_folds - 1)))).withColumn(
        "role", F.when(F.col("fold") == F.col("Fold_id"), F.lit("test")).otherwise(F.lit("train"))
    )
    pad = (ends["hi"] - ends["lo"]) * padding
    low, step = ends["lo"] - pad, (ends["hi"] - ends["lo"] + 2 * pad) / (points - 1)
    # bands has 2 * k_folds rows, and the grid's ends are one row.
    banded = values.join(F.broadcast(bands), ["fold", "role"]).withColumn("__low", low).withColumn("__step", step)
    at = "(__low + {i} * __step - v) / h"
    sums = [F.expr(f"sum(w * exp(-pow({at.format(i=i)}, 2) / 2)) AS s{i}") for i in range(points)]
    summed = banded.groupBy("fold", "role").agg(F.first("n").alias("n"), F.first("h").alias("h"), F.first("__low").alias("low"), F.first("__step").alias("step"), *sums)
    grid = F.expr("inline(array(" + ", ".join(f"struct({i} AS i, s{i} AS s)" for i in range(points)) + "))")
    return summed.select("fold", "role", "n", "h", "low", "step", grid).select(
        "fold", "role", "i", (F.col("low") + F.col("i") * F.col("step")).alias("x"),
        (F.col("s") / (math.sqrt(2 * math.pi) * F.col("h") * F.col("n"))).alias("density"),
    )
