"""Applying fitted model parameters to large tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ecoframe import config
from ecoframe.functions.nulls import clamp, col, safe_div, sum_of
from ecoframe.functions.stats import inverse_link
from ecoframe.operators.ranking import average_rank, quantiles
from ecoframe.operators.skew import attach, blocked_join
from ecoframe.session import materialise

INTERCEPT = "(Intercept)"


def formula_name(name: str) -> str:
    """Column name as used in model formulas: spaces become underscores."""
    return name.replace(" ", "_")


def score_mixed(
    df: DataFrame,
    coef: dict[str, float],
    re_study: DataFrame,
    re_block: DataFrame,
    terms: list[str],
    slopes: list[str],
    ids: list[str],
    link: str = "logit",
) -> DataFrame:
    """Fixed-effect and random-effect predictions of a mixed model.

    ``coef`` maps terms to estimates (one number per named column). ``re_study`` is long
    (SS, term, value), ``re_block`` is (SSB, value). Unseen studies and blocks contribute 0. The
    rows are never unpivoted: random effects become one wide row per study.
    """
    fixed = F.lit(float(coef[INTERCEPT])) + sum_of([F.lit(float(coef[t])) * col(t) for t in terms])
    study_terms = [INTERCEPT, *slopes]
    wide = re_study.filter(F.col("term").isin(study_terms)).groupBy("SS").agg(
        *[F.sum(F.when(F.col("term") == t, F.col("value"))).alias(f"__re{i}") for i, t in enumerate(study_terms)]
    )
    blocks = re_block.groupBy("SSB").agg(F.sum("value").alias("__reb"))
    joined = attach(attach(df, wide, ["SS"], null_safe=False), blocks, ["SSB"], null_safe=False)

    def effect(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0))

    random = effect("__re0") + effect("__reb")
    for i, t in enumerate(slopes, 1):
        random = random + effect(f"__re{i}") * col(t)
    return joined.select(
        *[col(c) for c in ids],
        inverse_link(fixed + random, link).alias("Predicted_RE"),
        inverse_link(fixed, link).alias("Predicted_FE"),
        inverse_link(F.lit(float(coef[INTERCEPT])), link).alias("Reference_pred_FE"),
    )


CHUNK_DRAWS = 64  # draws of a group that travel as one array


def _chunks(draws: DataFrame) -> DataFrame:
    """(level, group, draws): the draws of a group in arrays of about ``CHUNK_DRAWS``."""
    most = draws.groupBy("level", "group").count().agg(F.max("count")).first()[0] or 1
    chunk = F.pmod(F.xxhash64("chain", "draw"), F.lit(-(-most // CHUNK_DRAWS)))
    return draws.groupBy("level", "group", chunk.alias("__chunk")).agg(
        F.collect_list(F.struct("chain", "draw", "alpha", "beta")).alias("draws")
    )


def _with_known_group(df: DataFrame, draws: DataFrame, missing: str) -> DataFrame:
    """Rows whose group has no draws get the population's (level 0, group 0), or raise an error."""
    if missing not in ("population", "error"):
        raise ValueError("Unsupported missing. Allowed: population, error")
    known = draws.select("level", "group").distinct().withColumn("__known", F.lit(True))
    marked = attach(df, known, ["level", "group"])
    absent = F.col("__known").isNull()
    if missing == "error":
        absent = absent & F.raise_error(F.lit("A group has no draws")).cast("boolean")
    return marked.withColumn("level", F.when(absent, F.lit(0)).otherwise(F.col("level"))).withColumn(
        "group", F.when(absent, F.lit(0)).otherwise(F.col("group"))
    ).drop("__known")


def _linear(alpha: Column, beta: Column, x: Column) -> Column:
    dot = F.aggregate(F.zip_with(x, beta, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return alpha + dot


def _on_response(eta: Column, likelihood: str, eps: float) -> Column:
    if likelihood == "gaussian":
        return eta
    if likelihood == "beta":
        return clamp(inverse_link(eta, "logit"), eps, 1 - eps)
    raise ValueError("Unsupported likelihood. Allowed: gaussian, beta")


def score_hierarchical(
    df: DataFrame,
    draws: DataFrame,
    ids: list[str],
    x_cols: list[str],
    likelihood: str = "beta",
    eps: float = config.EPSILON,
    missing: str = "population",
) -> DataFrame:
    """Posterior mean prediction of every row from the draws of its assigned group.

    ``df`` has ``level`` and ``group`` (population rows use level 0); ``draws`` is
    (chain, draw, level, group, alpha, beta array). A row meets the draws of its group in arrays of
    bounded length, in cells of bounded size where a group is hot, and the partial sums are added
    by row. Rows whose group has no draws use the population's, or are an error with
    ``missing="error"``; without population draws their prediction is null.
    """
    x = F.array(*[col(c).cast("double") for c in x_cols])
    known = _with_known_group(df.withColumn("__x", x), draws, missing)
    rows = materialise(known.withColumn("__row", F.monotonically_increasing_id()), "scored")
    met = blocked_join(rows.select("__row", "__x", "level", "group"), _chunks(draws), ["level", "group"], ["__row"], ["__chunk"])

    def total(value) -> Column:
        return F.aggregate("draws", F.lit(0.0), lambda s, d: s + value(d))

    sums = met.groupBy("__row").agg(
        F.sum(total(lambda d: _on_response(_linear(d["alpha"], d["beta"], F.col("__x")), likelihood, eps))).alias("__p"),
        F.sum(total(lambda d: _on_response(d["alpha"], likelihood, eps))).alias("__r"),
        F.sum(F.size("draws")).alias("__n"),
    )
    return rows.join(sums, "__row", "left").select(
        *[col(c) for c in ids],
        safe_div(F.col("__p"), F.col("__n")).alias("Predicted"),
        safe_div(F.col("__r"), F.col("__n")).alias("Reference_pred"),
    )


def predictive_distribution(
    df: DataFrame,
    draws: DataFrame,
    ids: list[str],
    x_cols: list[str],
    likelihood: str = "beta",
    eps: float = config.EPSILON,
    missing: str = "population",
) -> DataFrame:
    """Conditional mean of every row under every draw of its group (``missing`` as above).

    To use fewer draws, filter ``draws`` first.
    """
    x = F.array(*[col(c).cast("double") for c in x_cols])
    known = _with_known_group(df.withColumn("__x", x), draws, missing)
    joined = blocked_join(known, _chunks(draws), ["level", "group"], ids, ["__chunk"])
    d = F.col("d")
    return joined.withColumn("d", F.explode("draws")).select(
        *[col(c) for c in ids],
        d["chain"].alias("Chain"),
        d["draw"].alias("Draw"),
        _on_response(_linear(d["alpha"], d["beta"], F.col("__x")), likelihood, eps).alias("Prediction"),
        _on_response(d["alpha"], likelihood, eps).alias("Reference_pred"),
    )


def label_draws(draws: DataFrame, mapping: DataFrame, variables: list[str]) -> DataFrame:
    """Names instead of indices: group label, and one row per slope with its variable name."""
    named = draws.join(
        mapping.select("level", F.col("idx").alias("group"), "label"), ["level", "group"]
    )
    names = F.array(*[F.lit(v) for v in variables])
    pairs = F.arrays_zip(names.alias("variable"), F.col("beta").alias("beta"))
    return named.select(
        "chain", "draw", "level", "label", "alpha", F.explode(pairs).alias("p")
    ).select("chain", "draw", "level", "label", "alpha", "p.variable", "p.beta")


def filter_draws(labelled: DataFrame, level: str, group: str) -> DataFrame:
    return labelled.filter((F.col("level") == level) & (F.col("label") == group))


def effect_summary(
    coef: DataFrame,
    re_study: DataFrame | None = None,
    boot: DataFrame | None = None,
    link: str = "logit",
    spread: tuple[float, float] = (0.05, 0.95),
) -> DataFrame:
    """Effects as changes on the response scale, with interval ends in ascending order.

    ``coef`` is (term, estimate, se). Intervals are estimate +- 1.96 se unless bootstrap
    estimates (term, estimate) are given. With study slopes the 5th and 95th percentile of the
    deviations are added around the estimate.
    """
    base = coef.filter(F.col("term") == INTERCEPT).agg(
        F.coalesce(F.max("estimate"), F.lit(0.0))
    ).scalar()

    def change(eta: Column) -> Column:
        return inverse_link(base + eta, link) - inverse_link(base, link)

    table = coef.filter(F.col("term") != INTERCEPT)
    low, high = F.col("estimate") - 1.96 * F.col("se"), F.col("estimate") + 1.96 * F.col("se")
    if boot is not None:
        ends = quantiles(boot, ["term"], "estimate", {"__lo": 0.025, "__hi": 0.975}, "linear")
        table = table.join(ends, "term", "left")
        low, high = F.coalesce("__lo", low), F.coalesce("__hi", high)
    out = table.select(
        "term",
        F.col("estimate").alias("__est"),
        change(F.col("estimate")).alias("mean"),
        F.least(change(low), change(high)).alias("ci_lower_2_5"),
        F.greatest(change(low), change(high)).alias("ci_upper_97_5"),
    )
    if re_study is not None:
        dev = re_study.filter(F.col("value").isNotNull())
        sizes = dev.groupBy("term").agg(F.count("value").alias("__n"))
        q = quantiles(dev, ["term"], "value", {"__q_lo": spread[0], "__q_hi": spread[1]}, "linear")
        q = q.join(sizes.filter(F.col("__n") > 1), "term")
        a, b = change(F.col("__est") + F.col("__q_lo")), change(F.col("__est") + F.col("__q_hi"))
        out = out.join(q, "term", "left").select(
            "term", "mean", "ci_lower_2_5", "ci_upper_97_5",
            F.least(a, b).alias("random_slope_lower"),
            F.greatest(a, b).alias("random_slope_upper"),
        )
    else:
        out = out.drop("__est")
    return out


def split_rhat(draws: DataFrame, keys: list[str], value: str, rank_normalised: bool = False) -> DataFrame:
    """Split R-hat per parameter: each chain is cut in two halves.

    ``draws`` needs ``chain`` and ``draw``. An odd middle draw is left out, as halves must be equal.
    """
    data, x = draws, col(value)
    if rank_normalised:
        data = average_rank(draws, value, keys, "__rank")
        x = F.col("__rank")
    length = data.groupBy(*keys, "chain").agg(
        F.min("draw").alias("__first"), (F.max("draw") - F.min("draw") + 1).alias("__len")
    )
    joined = attach(data, length, [*keys, "chain"])
    place, half = F.col("draw") - F.col("__first"), F.floor(F.col("__len") / 2)
    part = F.when(place < half, F.lit(0)).when(place >= F.col("__len") - half, F.lit(1))
    chains = (
        joined.withColumn("__part", part)
        .filter(F.col("__part").isNotNull())
        .groupBy(*keys, "chain", "__part")
        .agg(F.count(F.lit(1)).alias("__n"), F.avg(x).alias("__mean"), F.var_samp(x).alias("__var"))
    )
    return chains.groupBy(*keys).agg(
        F.sqrt(
            safe_div(
                (F.avg("__n") - 1) / F.avg("__n") * F.avg("__var") + F.var_samp("__mean"),
                F.avg("__var"),
            )
        ).alias("r_hat")
    )


def draw_diagnostics(draws: DataFrame, variable: str, keys: list[str], value: str) -> DataFrame:
    """R-hat per variable as mean, minimum and maximum over its parameters."""
    return split_rhat(draws, [variable, *keys], value).groupBy(variable).agg(
        F.avg("r_hat").alias("mean_r_hat"), F.min("r_hat").alias("min_r_hat"), F.max("r_hat").alias("max_r_hat")
    )


def sampler_summary(stats: DataFrame) -> DataFrame:
    """Divergences and mean acceptance of a run (diverging boolean, acceptance_rate)."""
    return stats.agg(
        F.sum(F.col("diverging").cast("int")).cast("long").alias("n_divergences"),
        F.avg("acceptance_rate").alias("mean_acceptance"),
    )


def interval_summary(draws: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean with the 2.5 and 97.5 percentile."""
    means = draws.groupBy(*keys).agg(F.avg(col(value)).alias("mean"))
    q = quantiles(draws, keys, value, {"perc_2_5": 0.025, "perc_97_5": 0.975}, "linear")
    if not keys:
        pick = means.scalar()
        return q.select(pick.alias("mean"), "perc_2_5", "perc_97_5")
    return attach(means, q, keys)
