from __future__ import annotations

from pyspark.sql import functions as F

from ecoframe.operators import scoring as sc
from registry.base import PARTS, query
from registry.transforms import site_features

_TERMS = ["Road_density_1km", "Elevation_1km"]
_COEF = {"(Intercept)": -0.3, "Road_density_1km": 0.004, "Elevation_1km": -0.002}

# Study intercepts and slopes for every second study, block intercepts for blocks 0 and 1.
PARTS["re_study"] = """
    SELECT 'S' || n_nationkey AS SS, '(Intercept)' AS term, (n_nationkey - 12) / 2e1 AS value FROM {nation} WHERE n_nationkey % 2 = 0
    UNION ALL SELECT 'S' || n_nationkey, 'Road_density_1km', (n_nationkey - 10) / 5e3 FROM {nation} WHERE n_nationkey % 2 = 0"""
PARTS["re_block"] = "SELECT DISTINCT SSB, c_nationkey / 4e1 AS value FROM {site_base} WHERE c_custkey % 4 < 2"


def _effects(v):
    n = F.col("n_nationkey")
    even = v("nation").filter(n % 2 == 0)
    ss = F.concat(F.lit("S"), n).alias("SS")
    study = even.select(ss, F.lit("(Intercept)").alias("term"), ((n - 12) / 20.0).alias("value")).unionByName(
        even.select(ss, F.lit("Road_density_1km").alias("term"), ((n - 10) / 5000.0).alias("value"))
    )
    block = v("site_base").filter(F.col("c_custkey") % 4 < 2).select("SSB", (F.col("c_nationkey") / 40.0).alias("value")).distinct()
    return study, block


_FE = "(-0.3e0 + 0.004e0 * Road_density_1km - 0.002e0 * Elevation_1km)"
_RE = "(coalesce(i.value, 0) + coalesce(s.value, 0) * Road_density_1km + coalesce(b.value, 0))"


@query(
    "score_mixed",
    f"""SELECT f.SSBS, 1 / (1 + exp(-({_FE} + {_RE}))) AS Predicted_RE, 1 / (1 + exp(-{_FE})) AS Predicted_FE, 1 / (1 + exp(0.3e0)) AS Reference_pred_FE
        FROM {{site_features}} f LEFT JOIN {{re_study}} i ON f.SS = i.SS AND i.term = '(Intercept)' LEFT JOIN {{re_study}} s ON f.SS = s.SS AND s.term <> '(Intercept)'
        LEFT JOIN {{re_block}} b ON f.SSB = b.SSB""",
    "Predicted_RE Predicted_FE Reference_pred_FE",
)
def _(v):
    study, block = _effects(v)
    return sc.score_mixed(site_features(v), _COEF, study, block, _TERMS, ["Road_density_1km"], ["SSBS"])


# Observations scored with the posterior: regions are the level 1 groups, one realm falls back to
# the population.
PARTS["scored_obs"] = """
    SELECT b.SSBS, b.c_custkey, CASE WHEN b.Realm = 'R2' THEN 0 ELSE 1 END AS level, CASE WHEN b.Realm = 'R2' THEN 0 ELSE n_regionkey END AS grp,
      Road_density_1km / 5e2 AS x1, Elevation_1km / 7.5e2 AS x2, Latitude / 6e1 AS x3, Longitude / 1.8e2 AS x4
    FROM {site_features} b JOIN {nation} n ON b.SS = 'S' || n_nationkey WHERE Road_density_1km IS NOT NULL"""
_X = [f"x{i}" for i in range(1, 5)]


def _observations(v):
    f = site_features(v).filter(F.col("Road_density_1km").isNotNull())
    n = v("nation").select(F.concat(F.lit("S"), "n_nationkey").alias("SS"), "n_regionkey")
    population = F.col("Realm") == "R2"
    return f.join(n, "SS").select(
        "SSBS", F.when(population, 0).otherwise(1).alias("level"),
        F.when(population, 0).otherwise(F.col("n_regionkey")).alias("group"),
        (F.col("Road_density_1km") / 500.0).alias("x1"), (F.col("Elevation_1km") / 750.0).alias("x2"),
        (F.col("Latitude") / 60.0).alias("x3"), (F.col("Longitude") / 180.0).alias("x4"),
    )


def _draws(v):
    return v("draws").select("chain", "draw", "level", "group", "alpha", F.array("b1", "b2", "b3", "b4").alias("beta"))


_ETA = "alpha + x1 * b1 + x2 * b2 + x3 * b3 + x4 * b4"


def _clipped(eta: str) -> str:
    return f"greatest(least(1 / (1 + exp(-({eta}))), 1 - 1e-6), 1e-6)"


PARTS["per_draw"] = f"SELECT SSBS, chain AS Chain, draw AS Draw, {_clipped(_ETA)} AS Prediction, {_clipped('alpha')} AS Reference_pred FROM {{scored_obs}} o JOIN {{draws}} d ON o.level = d.level AND o.grp = d.\"group\""


@query("score_hierarchical", "SELECT SSBS, avg(Prediction) AS Predicted, avg(Reference_pred) AS Reference_pred FROM {per_draw} GROUP BY SSBS", "Predicted Reference_pred")
def _(v):
    return sc.score_hierarchical(_observations(v), _draws(v), ["SSBS"], _X)


@query("predictive_distribution", "SELECT * FROM {per_draw}", "Prediction Reference_pred")
def _(v):
    return sc.predictive_distribution(_observations(v), _draws(v), ["SSBS"], _X)


_NAMES = ["roads", "elevation", "lat", "lon"]
PARTS["labelled_draws"] = " UNION ALL ".join(
    f"SELECT chain, draw, level, CASE WHEN level = 0 THEN 'population' ELSE r_name END AS label, alpha, '{n}' AS variable, b{i} AS beta FROM {{draws}} LEFT JOIN {{region}} ON r_regionkey = \"group\""
    for i, n in enumerate(_NAMES, 1)
)


def _labelled(v):
    mapping = v("region").select(F.lit(1).alias("level"), F.col("r_regionkey").alias("idx"), F.col("r_name").alias("label")).unionByName(
        v("region").filter("r_regionkey = 0").select(F.lit(0).alias("level"), F.lit(0).alias("idx"), F.lit("population").alias("label"))
    )
    return sc.label_draws(_draws(v), mapping, _NAMES)


@query("label_draws", "SELECT * FROM {labelled_draws}", "alpha beta")
def _(v):
    return _labelled(v)


@query("filter_draws", "SELECT * FROM {labelled_draws} WHERE level = 1 AND label = 'EUROPE'", "alpha beta")
def _(v):
    return sc.filter_draws(_labelled(v), 1, "EUROPE")


PARTS["coef"] = """SELECT '(Intercept)' AS term, -0.3e0 AS estimate, 0.1e0 AS se FROM {region} WHERE r_regionkey = 0
    UNION ALL SELECT 'x' || n_nationkey, (n_nationkey - 11) / 1e1, 0.05e0 + n_nationkey / 1e2 FROM {nation}"""
PARTS["slopes"] = "SELECT 'x' || n_nationkey AS term, (c_custkey * 31 % 200) / 1e2 - 1 AS value FROM {customer} JOIN {nation} ON n_nationkey = c_custkey % 25 WHERE n_nationkey < 20"


def _expit(x: str) -> str:
    return f"(1 / (1 + exp(-({x}))))"


def _change(x: str) -> str:
    return f"({_expit(f'-0.3e0 + {x}')} - {_expit('-0.3e0')})"


_LO, _HI = "(estimate - 1.96e0 * se)", "(estimate + 1.96e0 * se)"


@query(
    "effect_summary",
    f"""SELECT c.term, {_change('estimate')} AS mean, least({_change(_LO)}, {_change(_HI)}) AS ci_lower_2_5, greatest({_change(_LO)}, {_change(_HI)}) AS ci_upper_97_5,
          CASE WHEN n > 1 THEN least({_change('(estimate + lo)')}, {_change('(estimate + hi)')}) END AS random_slope_lower,
          CASE WHEN n > 1 THEN greatest({_change('(estimate + lo)')}, {_change('(estimate + hi)')}) END AS random_slope_upper
        FROM {{coef}} c LEFT JOIN (SELECT term, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi, count(*) AS n FROM {{slopes}} GROUP BY term) q ON c.term = q.term
        WHERE c.term <> '(Intercept)'""",
    "mean ci_lower_2_5 ci_upper_97_5 random_slope_lower random_slope_upper",
)
def _(v):
    n = F.col("n_nationkey")
    coef = v("region").filter("r_regionkey = 0").select(
        F.lit("(Intercept)").alias("term"), F.lit(-0.3).alias("estimate"), F.lit(0.1).alias("se")
    ).unionByName(
        v("nation").select(F.concat(F.lit("x"), n).alias("term"), ((n - 11) / 10.0).alias("estimate"), (0.05 + n / 100.0).alias("se"))
    )
    slopes = v("customer").filter(F.col("c_custkey") % 25 < 20).select(
        F.concat(F.lit("x"), F.col("c_custkey") % 25).alias("term"), ((F.col("c_custkey") * 31 % 200) / 100.0 - 1).alias("value")
    )
    return sc.effect_summary(coef, slopes)


PARTS["halves"] = """SELECT level, "group", variable, chain, CASE WHEN draw < 12 THEN 0 WHEN draw > 12 THEN 1 END AS part, beta FROM (
    """ + " UNION ALL ".join(f"SELECT level, \"group\", chain, draw, '{n}' AS variable, b{i} AS beta FROM {{draws}}" for i, n in enumerate(_NAMES, 1)) + ") u WHERE draw <> 12"


@query(
    "draw_diagnostics",
    """SELECT variable, avg(r) AS mean_r_hat, min(r) AS min_r_hat, max(r) AS max_r_hat FROM (
         SELECT variable, level, "group", sqrt((avg(n) - 1) / avg(n) + var_samp(m) / avg(s)) AS r FROM (
           SELECT variable, level, "group", chain, part, count(*) AS n, avg(beta) AS m, var_samp(beta) AS s FROM {halves} GROUP BY ALL) c GROUP BY variable, level, "group") x GROUP BY variable""",
    "mean_r_hat min_r_hat max_r_hat",
)
def _(v):
    return sc.draw_diagnostics(_labelled(v), "variable", ["level", "label"], "beta")


@query("sampler_summary", "SELECT CAST(sum(CASE WHEN draw % 11 = 0 AND chain = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_divergences, avg(0.8e0 + draw / 1e3) AS mean_acceptance FROM (SELECT DISTINCT chain, draw FROM {draws}) d", "mean_acceptance")
def _(v):
    d = v("draws").select("chain", "draw").distinct()
    return sc.sampler_summary(
        d.select(((F.col("draw") % 11 == 0) & (F.col("chain") == 1)).alias("diverging"), (0.8 + F.col("draw") / 1000.0).alias("acceptance_rate"))
    )


@query("interval_summary", 'SELECT level, "group", avg(alpha) AS mean, quantile_cont(alpha, 0.025) AS perc_2_5, quantile_cont(alpha, 0.975) AS perc_97_5 FROM {draws} GROUP BY level, "group"', "mean perc_2_5 perc_97_5")
def _(v):
    return sc.interval_summary(v("draws"), ["level", "group"], "alpha")
