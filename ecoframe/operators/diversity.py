"""Alpha and beta diversity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ecoframe import config
from ecoframe.functions.nulls import (
    all_of,
    col,
    finite_text,
    safe_div,
    sum_of,
    sum_or_zero,
)
from ecoframe.operators import composition, joins
from ecoframe.operators.ranking import attributes_per_key, first_per_key, quantiles
from ecoframe.operators.skew import attach
from ecoframe.session import materialise

ALPHA_METRICS = [
    "Total_abundance",
    "Mean_abundance",
    "Geometric_mean_abundance",
    "Species_richness",
    "Shannon_index",
    "Modified_Shannon_index",
]


def taxon_columns(keys: list[str]) -> list[str]:
    return [k for k in keys if k not in config.SITE_KEYS]


def scale_by_study_max(df: DataFrame, metrics: list[str], tax_cols: list[str]) -> DataFrame:
    """Divide metrics by their maximum within (study, taxon); 0 where the maximum is 0.

    Aggregate and join back: maxima combine map-side, a hot study is never one sort.
    """
    keys = ["SS", *tax_cols]
    maxima = df.groupBy(*[col(k) for k in keys]).agg(
        *[F.max(col(m)).alias(f"Study_max_{m}") for m in metrics]
    )
    joined = attach(df, maxima, keys, null_safe=False)
    scaled = [
        F.when(col(f"Study_max_{m}") == 0, F.lit(0.0))
        .otherwise(safe_div(col(m), col(f"Study_max_{m}")))
        .alias(f"Scaled_{m}")
        for m in metrics
    ]
    own = [col(c) for c in df.columns]
    return joined.select(*own, *[col(f"Study_max_{m}") for m in metrics], *scaled)


def _metric_columns() -> dict[str, Column]:
    """All alpha metrics as aggregates over the rows of one site (and taxon).

    Shannon: with T the total abundance, -sum(p ln p) for p = y / T equals
    (ln T * sum(y) - sum(y ln y)) / T, so no second pass over the rows is needed.
    """
    y = F.col("Effort_corrected_measurement").cast("double")
    in_scope = F.col("Diversity_metric_type") == "Abundance"
    total = sum_or_zero(F.when(in_scope, y))
    richness = F.sum(F.when(in_scope & (y > 0), 1).otherwise(0))
    positive = F.when(y > 0, y)
    entropy = (F.ln(total) * sum_or_zero(positive) - sum_or_zero(positive * F.ln(positive))) / total
    shannon = F.when((richness == 1) | (total == 0), F.lit(0.0)).otherwise(
        F.when(total > 0, entropy)
    )
    return {
        "Total_abundance": total,
        "Mean_abundance": F.avg(F.when(in_scope, y)),
        "Geometric_mean_abundance": F.exp(F.avg(F.log1p(y))) - 1,
        "Species_richness": richness.cast("long"),
        "Shannon_index": shannon,
        "Modified_Shannon_index": F.ln(total + 1) * shannon,
        "__n_abundance": F.sum(F.when(in_scope, 1).otherwise(0)),
    }


def _metrics(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Wanted metrics per key, scaled; only keys with abundance rows, except the geometric mean."""
    exprs = _metric_columns()
    wanted = metrics + ["__n_abundance"]
    base = df.groupBy(*[col(k) for k in keys]).agg(*[exprs[m].alias(m) for m in wanted])
    if metrics == ["Geometric_mean_abundance"]:
        base = base.drop("__n_abundance")
    else:
        base = base.filter(F.col("__n_abundance") > 0).drop("__n_abundance")
    return scale_by_study_max(base, metrics, taxon_columns(keys))


def total_abundance(df: DataFrame, keys: list[str]) -> DataFrame:
    return _metrics(df, keys, ["Total_abundance"])


def mean_abundance(df: DataFrame, keys: list[str]) -> DataFrame:
    return _metrics(df, keys, ["Mean_abundance"])


def geometric_mean_abundance(df: DataFrame, keys: list[str]) -> DataFrame:
    """exp(mean(ln(y + 1))) - 1 over all rows, whatever their metric type."""
    return _metrics(df, keys, ["Geometric_mean_abundance"])


def species_richness(df: DataFrame, keys: list[str]) -> DataFrame:
    """Number of rows with a positive measurement."""
    return _metrics(df, keys, ["Species_richness"])


def shannon_index(df: DataFrame, keys: list[str]) -> DataFrame:
    return _metrics(df, keys, ["Shannon_index", "Modified_Shannon_index"])


def site_attributes(df: DataFrame, order: list[str]) -> DataFrame:
    """One row per site: the first under a declared order."""
    return first_per_key(df, ["SSBS"], order)


def alpha_diversity(df: DataFrame, level: int, order: list[str], taxonomic_levels: list[str] | None = None) -> DataFrame:
    """All alpha metrics of one aggregation level plus the attributes of the site.

    ``level`` is the number of taxonomic levels added to the site keys. All metrics come from a
    single aggregation; study maxima of the geometric mean see every metric type, those of the
    other metrics only keys with abundance rows.
    """
    levels = taxonomic_levels or [t for t in config.TAXONOMIC_LEVELS if t in df.columns]
    tax = levels[:level]
    keys = config.SITE_KEYS + tax
    exprs = _metric_columns()
    base = df.groupBy(*[col(k) for k in keys]).agg(*[e.alias(m) for m, e in exprs.items()])
    in_scope = F.col("__n_abundance") > 0
    other = [m for m in ALPHA_METRICS if m != "Geometric_mean_abundance"]
    limited = base.select(
        *[col(k) for k in keys],
        *[(F.when(in_scope, col(m)) if m in other else col(m)).alias(m) for m in ALPHA_METRICS],
        "__n_abundance",
    )
    scaled = scale_by_study_max(limited, ALPHA_METRICS, tax).filter(in_scope).drop("__n_abundance")
    if tax:
        # The metric tables are joined one to the other on the keys, where null never matches.
        complete = all_of([col(t).isNotNull() for t in tax])
        kept = set(keys) | {"Total_abundance", "Study_max_Total_abundance", "Scaled_Total_abundance"}
        scaled = scaled.select(
            *[col(c) if c in kept else F.when(complete, col(c)).alias(c) for c in scaled.columns]
        )
    dropped = {"Taxon_name_entered", "Measurement", "Effort_corrected_measurement", *levels[level:]}
    kept = [c for c in df.columns if c not in {*dropped, "SS", "SSB", "SSBS", *tax}]
    attributes = attributes_per_key(df, ["SSBS"], kept, order)
    return scaled.join(attributes, "SSBS", "left")


def _abundance_states() -> dict[str, Column]:
    """Sums from which all alpha metrics follow; those of several groups add up to those of their union."""
    y = F.col("Effort_corrected_measurement").cast("double")
    in_scope = F.col("Diversity_metric_type") == "Abundance"
    positive, counted = F.when(y > 0, y), F.when(in_scope, y)
    return {
        "__total": F.sum(counted), "__n_known": F.count(counted), "__n_abundance": F.sum(F.when(in_scope, 1).otherwise(0)),
        "__logs": F.sum(F.log1p(y)), "__n_logs": F.count(y), "__rich": F.sum(F.when(in_scope & (y > 0), 1).otherwise(0)),
        "__positive": F.sum(positive), "__y_ln_y": F.sum(positive * F.ln(positive)),
    }


def _metrics_of_states() -> dict[str, Column]:
    total, richness = F.coalesce("__total", F.lit(0.0)), F.col("__rich")
    entropy = (F.ln(total) * F.coalesce("__positive", F.lit(0.0)) - F.coalesce("__y_ln_y", F.lit(0.0))) / total
    shannon = F.when((richness == 1) | (total == 0), F.lit(0.0)).otherwise(F.when(total > 0, entropy))
    return {
        "Total_abundance": total,
        "Mean_abundance": safe_div(F.col("__total"), F.col("__n_known")),
        "Geometric_mean_abundance": F.exp(safe_div(F.col("__logs"), F.col("__n_logs"))) - 1,
        "Species_richness": richness.cast("long"),
        "Shannon_index": shannon,
        "Modified_Shannon_index": F.ln(total + 1) * shannon,
    }


def alpha_diversity_levels(df: DataFrame, levels: list[int], order: list[str], taxonomic_levels: list[str] | None = None) -> DataFrame:
    """:func:`alpha_diversity` of several taxonomic levels at once, told apart by ``level``.

    The rows are aggregated once, at the deepest level; grouping sets over the taxon path add those
    sums up for the others, so observations are read and shuffled once however many levels are asked for.
    Taxon columns below a row's level are null.
    """
    known = taxonomic_levels or [t for t in config.TAXONOMIC_LEVELS if t in df.columns]
    tax = known[: max(levels)]
    states = _abundance_states()
    base = df.groupBy(*[col(k) for k in config.SITE_KEYS + tax]).agg(*[e.alias(n) for n, e in states.items()])
    site = [col(k) for k in config.SITE_KEYS]
    sets = [site + [col(t) for t in tax[:level]] for level in sorted(set(levels))]
    level = sum_of([F.lit(len(tax)), *[-F.grouping(col(t)) for t in tax]]).cast("int")
    rolled = base.groupingSets(sets, *site, *[col(t) for t in tax]).agg(level.alias("level"), *[F.sum(n).alias(n) for n in states])
    in_scope = F.col("__n_abundance") > 0
    metrics = _metrics_of_states()
    limited = rolled.select(
        "level", *site, *[col(t) for t in tax],
        *[(e if m == "Geometric_mean_abundance" else F.when(in_scope, e)).alias(m) for m, e in metrics.items()],
        in_scope.alias("__kept"),
    )
    complete = all_of([F.lit(True), *[(F.col("level") <= i) | col(t).isNotNull() for i, t in enumerate(tax)]])
    # Units with an unknown taxon have no study maximum; columns below the level are null on both sides.
    unit = F.when(complete, F.struct("level", *[col(t) for t in tax]))
    scaled = scale_by_study_max(limited.withColumn("__unit", unit), ALPHA_METRICS, ["__unit"]).filter("__kept").drop("__kept", "__unit")
    always = {"level", *config.SITE_KEYS, *tax, "Total_abundance", "Study_max_Total_abundance", "Scaled_Total_abundance"}
    scaled = scaled.select(*[col(c) if c in always else F.when(complete, col(c)).alias(c) for c in scaled.columns])
    dropped = {"Taxon_name_entered", "Measurement", "Effort_corrected_measurement", *known, *config.SITE_KEYS}
    attributes = attributes_per_key(df, ["SSBS"], [c for c in df.columns if c not in dropped], order)
    return scaled.join(attributes, "SSBS", "left")


def study_mean_table(df: DataFrame, variables: list[str]) -> DataFrame:
    """Mean of the density columns (and their transforms) per study, as ``Mean_<lower name>``."""
    targets = [v for v in variables if "pop_density" in v.lower() or "road_density" in v.lower()]
    return df.groupBy("SS").agg(*[F.expr(f"avg(`{v}`) AS `Mean_{v.lower()}`") for v in targets])


def study_means(df: DataFrame, variables: list[str]) -> DataFrame:
    """Mean density per study, joined back to the rows."""
    means = study_mean_table(df, variables)
    return attach(df, means, ["SS"], null_safe=False).select(
        *[col(c) for c in df.columns], *[col(c) for c in means.columns if c != "SS"]
    )


def impute_hierarchical(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fill invalid values from the block, then the study, then the global mean.

    The study mean is taken over block-imputed values and the global mean over study-imputed
    ones. Both follow from (valid sum, valid count, row count) per (block, study): a block with a
    mean contributes its valid sum plus that mean for each invalid row. So the rows are
    aggregated once, and everything above works on the block table.
    """
    present = [c for c in columns if c in df.columns]
    idx = range(len(present))

    def aggregate(grouped: DataFrame, keys: list[str], exprs: list[str]) -> DataFrame:
        return grouped.groupBy(*keys).agg(*[F.expr(e) for e in exprs])

    def filled(i: int, size: str, mean: str) -> list[str]:
        """Sum and count after giving every invalid row the mean, where there is one."""
        s, c = f"coalesce(s{i}, 0D)", f"c{i}"
        return [
            f"CASE WHEN {mean} IS NULL THEN {s} ELSE {s} + ({size} - {c}) * {mean} END AS s{i}",
            f"CASE WHEN {mean} IS NULL THEN {c} ELSE {size} END AS c{i}",
        ]

    valid = {i: finite_text(c) for i, c in enumerate(present)}
    base = aggregate(
        df, ["SS", "SSB"],
        ["count(1) AS n"]
        + [f"sum({valid[i]}) AS s{i}" for i in idx]
        + [f"count({valid[i]}) AS c{i}" for i in idx],
    )
    # Block means use the block key alone, over all studies it may appear in; null keys never match.
    block = aggregate(base, ["SSB"], [f"try_divide(sum(s{i}), sum(c{i})) AS mb{i}" for i in idx])
    with_block = attach(base, block, ["SSB"], null_safe=False).selectExpr(
        "SS", "SSB", "n", *[f"mb{i}" for i in idx], *[e for i in idx for e in filled(i, "n", f"mb{i}")]
    )
    study = aggregate(
        with_block, ["SS"],
        ["sum(n) AS n"] + [f"sum(s{i}) AS s{i}" for i in idx] + [f"sum(c{i}) AS c{i}" for i in idx],
    ).selectExpr("*", *[f"CASE WHEN SS IS NOT NULL THEN try_divide(s{i}, c{i}) END AS ms{i}" for i in idx])
    overall = (
        study.selectExpr(*[e for i in idx for e in filled(i, "n", f"ms{i}")])
        .selectExpr(f"struct({', '.join(f'try_divide(sum(s{i}), sum(c{i})) AS g{i}' for i in idx)}) AS g")
        .scalar()
    )
    # One row per block, with the values for all three levels side by side.
    means = attach(
        with_block.select("SS", "SSB", *[f"mb{i}" for i in idx]),
        study.select("SS", *[f"ms{i}" for i in idx]),
        ["SS"],
    ).select("SS", "SSB", *[f"mb{i}" for i in idx], *[f"ms{i}" for i in idx], overall.alias("g"))
    means = means.selectExpr(
        "SS", "SSB", *[f"coalesce(mb{i}, ms{i}, g.g{i}) AS `__fill{i}`" for i in idx]
    )
    place = {c: i for i, c in enumerate(present)}
    return attach(df, means, ["SS", "SSB"]).selectExpr(
        *[
            f"coalesce({valid[place[c]]}, `__fill{place[c]}`) AS `{c}`" if c in place else f"`{c}`"
            for c in df.columns
        ]
    )


def median_extent(sites: DataFrame) -> DataFrame:
    """Median of the maximum linear extent over sites (midpoint of the two middle values)."""
    return quantiles(sites, [], "Max_linear_extent_metres", {"median_extent": 0.5}, "linear")


# --- beta diversity -------------------------------------------------------------------------


def _score(
    pairs: DataFrame | None,
    obs: DataFrame,
    tax_cols: list[str],
    flags: DataFrame | None = None,
    carried: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """2 * sum(min(a, b)) / (sum(a) + sum(b)) for given pairs, per taxon unit if asked for.

    Measurements are never negative, so rows of 0 add nothing to the minimum and neither do the taxa
    of only one site. Repeated taxon names meet all rows of that name at the other site; equal
    (site, taxon, value) rows are therefore counted first and weighted.
    """
    value = F.coalesce(F.col("Measurement").cast("double"), F.lit(0.0))
    # Read for the dictionary, the sizes and the packed sites, hence written once.
    counted = materialise(
        obs.groupBy("SS", "SSBS", *[col(t) for t in tax_cols], "Taxon_name_entered", value.alias("v")).agg(
            F.count(F.lit(1)).alias("w")
        ),
        "taxa",
    )
    scored = composition.overlaps(pairs, counted, tax_cols, flags, carried)
    a, b = F.col("total_1"), F.col("total_2")
    score = (
        F.when((a == 0) & (b == 0), F.lit(None).cast("double"))
        .when((a == 0) | (b == 0), F.lit(0.0))
        .otherwise(safe_div(2 * F.col("overlap"), a + b))
    )
    return scored.select(
        "SS", "Primary_minimal_site", "Other_site", *[col(t) for t in tax_cols],
        score.alias("Bray_Curtis_score"), *(["__reference", "__other"] if carried else []),
    )


def reference_bray_curtis(
    obs: DataFrame, listed: DataFrame, tax_cols: list[str], carried: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """Similarity of all reference pairs of ``obs`` by the taxa of ``listed``, per taxon unit if asked for.

    As :func:`bray_curtis` and :func:`bray_curtis_by_taxon` on the pair list, which is never written or shuffled.
    """
    flags = materialise(joins.site_flags(obs), "sites")
    known = listed.filter(all_of([col(t).isNotNull() for t in tax_cols])) if tax_cols else listed
    return _score(None, known, tax_cols, flags, carried)


def bray_curtis(pairs: DataFrame, obs: DataFrame) -> DataFrame:
    """Compositional similarity of site pairs over all taxa, on raw measurements."""
    return _score(pairs, obs, [])


def bray_curtis_by_taxon(pairs: DataFrame, obs: DataFrame, tax_cols: list[str]) -> DataFrame:
    """Similarity inside every taxon unit that both sites have."""
    known = obs.filter(all_of([col(t).isNotNull() for t in tax_cols]))
    return _score(pairs, known, tax_cols) if tax_cols else _score(pairs, obs, [])


def haversine(pairs: DataFrame, extent: Column) -> DataFrame:
    """Great-circle distance of a pair over the median site extent, with its transforms."""
    lat1, lat2 = F.radians("Latitude"), F.radians("Latitude_reference")
    dlat = lat2 - lat1
    dlon = F.radians("Longitude_reference") - F.radians("Longitude")
    a = F.pow(F.sin(dlat / 2), F.lit(2)) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin(dlon / 2), F.lit(2))
    metres = config.EARTH_RADIUS_M * 2 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))
    return _with_distance(pairs, "Haversine_distance", safe_div(metres, extent))


def gower_pair(pairs: DataFrame, variables: list[str], scope: str = "pair", ranges: Column | None = None) -> DataFrame:
    """Environmental distance of a pair.

    ``pair`` normalises over the two rows only, so a differing variable counts 1; ``global``
    divides by the given range of the variable over all sites.
    """
    terms = []
    for v in variables:
        a, b = col(v).cast("double"), col(f"{v}_reference").cast("double")
        if scope == "pair":
            same = (a == b) | (F.greatest(a, b) == 0)
            terms.append(F.when(a.isNull() | b.isNull(), F.lit(None)).when(same, 0.0).otherwise(1.0))
        elif scope == "global":
            width = ranges[v]
            terms.append(F.when(width == 0, F.lit(0.0)).otherwise(safe_div(F.abs(a - b), width)))
        else:
            raise ValueError(f"Unsupported scope: {scope}")
    return _with_distance(pairs, "Gower_distance", sum_of(terms) / len(variables))


def _with_distance(df: DataFrame, name: str, d: Column) -> DataFrame:
    out = df.withColumn(name, d)
    x = F.col(name)
    return out.select(
        "*",
        F.ln(x + 1).alias(f"{name}_log"),
        F.sqrt(x + 1).alias(f"{name}_sqrt"),
        F.pow(x, F.lit(1 / 3)).alias(f"{name}_cbrt"),
    )


def beta_diversity(
    df: DataFrame,
    level: int,
    order: list[str],
    continuous: list[str],
    environment: list[str],
    taxonomic_levels: list[str] | None = None,
) -> DataFrame:
    """Similarity, feature differences and distances of all reference pairs, in one plan."""
    levels = taxonomic_levels or [t for t in config.TAXONOMIC_LEVELS if t in df.columns]
    tax = levels[:level]
    in_scope = materialise(
        joins.filter_studies(df).select(
            "SS", "SSBS", "Taxon_name_entered", "Measurement",
            "Predominant_land_use", "Use_intensity", *[col(t) for t in tax],
        ),
        "in-scope",
    )
    sites = materialise(site_attributes(df, order), "sites")
    extent = median_extent(sites.select("Max_linear_extent_metres")).scalar()
    clean = sites.drop("Taxon_name_entered", "Measurement", "Effort_corrected_measurement", *levels)
    # Features travel with the sites into the cells where these are paired.
    carried = joins.pair_structs(clean, continuous)
    scored = reference_bray_curtis(in_scope, in_scope, tax, carried)
    out = joins.unpacked_pairs(scored, continuous)
    out = haversine(out, extent)
    out = gower_pair(out, environment)
    kept = [c for c in out.columns if not c.endswith("_reference")]
    out = out.select(*[col(c) for c in kept]).withColumnRenamed("Other_site", "SSBS")
    missing = [k for k in config.SITE_KEYS + tax if k not in out.columns]
    if missing:
        raise ValueError(f"Grouping columns missing from the result: {missing}")
    nan = F.isnan("Bray_Curtis_score")
    guard = F.when(nan, F.raise_error(F.lit("NaN similarity score"))).otherwise(F.col("Bray_Curtis_score"))
    return out.withColumn("Bray_Curtis_score", guard.cast("double"))


def interpolate_population(
    df: DataFrame,
    prefix: str,
    intervals: list[tuple[int, int]] | None = None,
    name: str = "Pop_density",
) -> DataFrame:
    """Yearly population per site from census columns ``<prefix><year>``, exponential growth.

    The first interval is extrapolated backwards with the growth of the second. The end year of an
    interval is recomputed from its start before the next interval begins, so a zero census
    carries the previous value forward.
    """
    spans = intervals or config.POPULATION_INTERVALS

    def growth(start: Column, end: Column, years: int) -> Column:
        rate = F.ln(F.when((start > 0) & (end > 0), safe_div(end, start))) / years
        missing = start.isNull() | end.isNull()
        return F.when(missing, F.lit(None).cast("double")).otherwise(F.coalesce(rate, F.lit(0.0)))

    first, second = spans[0], spans[1]
    census = {end: col(f"{prefix}{end}").cast("double") for _, end in spans}
    back = growth(census[second[0]], census[second[1]], second[1] - second[0])
    opening = census[first[1]] * F.exp(back * (first[0] - first[1]))

    # One column pair (value at the start, growth rate) per interval, each from the one before.
    work = df.select("SSBS", *[census[e].alias(f"__y{e}") for _, e in spans], opening.alias(f"__y{first[0]}"))
    for start, end in spans:
        work = work.withColumn(
            f"__r{start}", growth(F.col(f"__y{start}"), F.col(f"__y{end}"), end - start)
        )
        work = work.withColumn(
            f"__y{end}", F.col(f"__y{start}") * F.exp(F.col(f"__r{start}") * (end - start))
        )
    last = spans[-1][1]
    years = work.withColumn("Year", F.explode(F.sequence(F.lit(first[0]), F.lit(last))))
    value = F.when(F.lit(False), F.lit(0.0))
    for i, (start, end) in enumerate(spans):
        low = start if i == 0 else start + 1
        value = value.when(
            F.col("Year").between(low, end),
            F.col(f"__y{start}") * F.exp(F.col(f"__r{start}") * (F.col("Year") - start)),
        )
    return years.select("SSBS", F.col("Year").cast("int").alias("Year"), value.alias(name))
