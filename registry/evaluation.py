from __future__ import annotations

from pyspark.sql import functions as F

from ecoframe.operators import evaluate as e
from ecoframe.session import materialise
from registry.base import PARTS, query
from registry.geo import _CORR
from registry.scoring import _draws, _observations, _X
from fixtures import COVARIATE_NAMES

_TIES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_BY = ", ".join(_TIES)


@query("frequency_table", "SELECT Biome, count(SSBS) AS samples, count(DISTINCT SS) AS studies FROM {site_obs} GROUP BY Biome")
def _(v):
    return e.frequency_table(v("site_obs"), "Biome", "samples", "studies")


@query("sites_per_study", "SELECT SS, count(DISTINCT SSBS) AS n_sites FROM {site_obs} GROUP BY SS")
def _(v):
    return e.sites_per_study(v("site_obs"))


@query(
    "study_size_shares",
    "SELECT count(*) AS n_studies, avg(CASE WHEN n <= 55 THEN 1e0 ELSE 0e0 END) AS share_up_to_55, avg(CASE WHEN n <= 60 THEN 1e0 ELSE 0e0 END) AS share_up_to_60, CAST(sum(CASE WHEN n <= 65 THEN 1 ELSE 0 END) AS BIGINT) AS n_up_to_65 FROM (SELECT SS, count(DISTINCT SSBS) AS n FROM {site_obs} GROUP BY SS) t",
    "share_up_to_55 share_up_to_60",
)
def _(v):
    return e.study_size_shares(e.sites_per_study(v("site_obs")), (55, 60), 65)


_BIN = "CAST(least(floor(({0} - lo) / w), 19) AS INT)"
PARTS["hist_ends"] = "SELECT least(min(Observed), min(Predicted)) AS lo, (greatest(max(Observed), max(Predicted)) - least(min(Observed), min(Predicted))) / 20 AS w FROM {pred_site}"
PARTS["hist_counts"] = " UNION ALL ".join(
    f"SELECT '{c}' AS c, {_BIN.format(c)} AS b, count(*) AS n FROM {{pred_site}}, {{hist_ends}} GROUP BY 1, 2" for c in ("Observed", "Predicted")
)


@query(
    "histogram",
    """SELECT k.c AS "column", CAST(i AS INT) AS bin, coalesce(n, 0) AS n, lo + i * w AS bin_start, lo + (i + 1) * w AS bin_end
       FROM (SELECT 'Observed' AS c UNION ALL SELECT 'Predicted') k CROSS JOIN range(0, 20) g(i) CROSS JOIN {hist_ends} LEFT JOIN {hist_counts} h ON h.c = k.c AND h.b = i""",
    "bin_start bin_end",
)
def _(v):
    return e.histogram(v("pred_site"), ["Observed", "Predicted"], 20)


# --- accuracy -------------------------------------------------------------------------------


def segments_part(source: str, keys: str, predicted: str) -> str:
    """Rows of ``source`` repeated per segment, quarters taken by rank within ``keys``."""
    part = f"PARTITION BY {keys}" if keys else ""
    return (
        f"SELECT t.*, s.segment FROM (SELECT *, {predicted} AS p, ceil(4 * row_number() OVER ({part} ORDER BY Observed, {_BY}) / count(*) OVER ({part})) - 1 AS bin FROM {source}) t "
        "JOIN (SELECT 'overall' AS segment, -1 AS b UNION ALL SELECT 'bottom', 0 UNION ALL SELECT 'top', 3) s ON s.b = -1 OR s.b = t.bin"
    )


def metrics_sql(part: str, keys: list[str], spread: str = "p") -> str:
    by = ", ".join([*keys, "segment"])
    ranked = (
        f"SELECT *, rank() OVER (PARTITION BY {by} ORDER BY Observed) + (count(*) OVER (PARTITION BY {by}, Observed) - 1) / 2 AS rx, "
        f"rank() OVER (PARTITION BY {by} ORDER BY p) + (count(*) OVER (PARTITION BY {by}, p) - 1) / 2 AS ry FROM {{{part}}}"
    )
    return f"""
        SELECT {by}, count(*) AS n, CASE WHEN var_pop(Observed) > 0 THEN 1 - avg((Observed - p) * (Observed - p)) / var_pop(Observed) END AS r2_std,
          CASE WHEN var_pop({spread}) + var_pop(Observed - p) > 0 THEN var_pop(p) / (var_pop({spread}) + var_pop(Observed - p)) END AS r2_var,
          avg(abs(Observed - p)) AS mean_abs_error, {_CORR.format('Observed', 'p')} AS pearson_corr,
          CASE WHEN abs(avg(Observed)) > 1e-8 THEN avg(p) / avg(Observed) END AS bias_ratio,
          quantile_cont(abs(Observed - p), 0.5) AS median_abs_error, {_CORR.format('rx', 'ry')} AS spearman_corr
        FROM ({ranked}) r GROUP BY {by}"""


_METRICS = ["r2_std", "r2_var", "mean_abs_error", "pearson_corr", "bias_ratio", "median_abs_error", "spearman_corr"]
PARTS["segments"] = segments_part("{predictions}", "", "Predicted_FE")


@query("performance_metrics", metrics_sql("segments", [], "Predicted_RE"), _METRICS)
def _(v):
    rows = materialise(v("predictions").select(*_TIES, "Observed", "Predicted_FE", "Predicted_RE"), "predictions")
    return e.performance_metrics(rows, _TIES, "Predicted_FE", spread="Predicted_RE")


_TENTH = f"CAST(ceil(10 * row_number() OVER (ORDER BY Observed, {_BY}) / count(*) OVER ()) AS INT)"
_QUARTER = f"ceil(4 * row_number() OVER (ORDER BY Observed, {_BY}) / count(*) OVER ()) - 1"
_BIAS = "CASE WHEN abs(avg(Observed)) > 1e-8 THEN avg(Predicted_FE) / avg(Observed) END AS bias_ratio"


@query(
    "bias_ratios",
    f"""SELECT section, count(*) AS n, {_BIAS} FROM (
          SELECT 'overall' AS section, Observed, Predicted_FE FROM {{predictions}}
          UNION ALL SELECT CASE q WHEN 0 THEN 'bottom_quartile' ELSE 'top_quartile' END, Observed, Predicted_FE FROM (SELECT *, {_QUARTER} AS q FROM {{predictions}}) a WHERE q IN (0, 3)
          UNION ALL SELECT 'decile_' || {_TENTH}, Observed, Predicted_FE FROM {{predictions}}) u GROUP BY section""",
    "bias_ratio",
)
def _(v):
    return e.bias_ratios(v("predictions"), _TIES, "Predicted_FE")


PARTS["fold_roles"] = "SELECT p.* EXCLUDE (fold), k.fold, CASE WHEN p.fold = k.fold THEN 'test' ELSE 'train' END AS role FROM {predictions} p CROSS JOIN (SELECT DISTINCT fold FROM {predictions}) k"
PARTS["role_segments"] = segments_part("{fold_roles}", "fold, role", "Predicted_FE")
_LONG = ["r2_std", "r2_var", "mean_abs_error", "median_abs_error", "pearson_corr", "spearman_corr", "bias_ratio"]


@query(
    "cv_summary",
    " UNION ALL ".join(f"SELECT role, segment, '{m}' AS metric, avg({m}) AS mean, min({m}) AS min, max({m}) AS max FROM {{cv_metrics}} GROUP BY role, segment" for m in _LONG),
    "mean min max",
)
def _(v):
    from ecoframe.operators.folds import with_roles

    # Written before the folds repeat each row, as the metrics read it several times.
    rows = materialise(v("predictions").select(*_TIES, "Observed", "Predicted_FE", F.col("fold").alias("Fold_id")), "folds")
    df = with_roles(rows, 5)
    return e.cv_summary(e.performance_metrics(df, _TIES, "Predicted_FE", keys=["fold", "role"]))


PARTS["cv_metrics"] = metrics_sql("role_segments", ["fold", "role"])


@query("safe_corr", f"SELECT SSBS, {_CORR.format('Observed', 'Predicted_FE')} AS pearson_r FROM {{predictions}} GROUP BY SSBS", "pearson_r")
def _(v):
    return e.safe_correlation(v("predictions"), ["SSBS"], "Observed", "Predicted_FE")


PARTS["fold_r"] = f"SELECT model, mode, fold, {_CORR.format('Observed', 'Predicted_FE')} AS r FROM {{predictions}} WHERE mode <> 'Training' GROUP BY model, mode, fold"


@query(
    "model_performance_table",
    f"SELECT a.model, a.mode, a.r AS Mean, b.lo AS Min, b.hi AS Max, b.r0 AS r_fold_0, b.r1 AS r_fold_1, b.r2 AS r_fold_2, b.r3 AS r_fold_3, b.r4 AS r_fold_4 FROM (SELECT model, mode, {_CORR.format('Observed', 'Predicted_FE')} AS r FROM {{predictions}} GROUP BY model, mode) a "
    "LEFT JOIN (SELECT model, mode, min(r) AS lo, max(r) AS hi, " + ", ".join(f"max(CASE WHEN fold = {k} THEN r END) AS r{k}" for k in range(5)) + " FROM {fold_r} GROUP BY model, mode) b ON a.model = b.model AND a.mode = b.mode",
    "Mean Min Max r_fold_0 r_fold_1 r_fold_2 r_fold_3 r_fold_4",
)
def _(v):
    out = e.model_performance_table(v("predictions"), predicted="Predicted_FE")
    folds = [F.try_element_at("r_fold", F.lit(k)).alias(f"r_fold_{k}") for k in range(5)]
    return out.select("model", "mode", "Mean", "Min", "Max", *folds)


@query("fold_correlations", "SELECT * FROM {fold_r}", "r")
def _(v):
    return e.fold_correlations(v("predictions"), predicted="Predicted_FE")


_PAIR = """a.SSBS AS site_1, b.SSBS AS site_2, b.Observed - a.Observed AS Observed, b.Predicted - a.Predicted AS Predicted,
    (b.Predicted - a.Predicted) - (b.Observed - a.Observed) AS residual, a.Predominant_land_use AS lu_1, a.Use_intensity AS ui_1, b.Predominant_land_use AS lu_2, b.Use_intensity AS ui_2"""


@query("delta_predictions", f"SELECT a.SSB, {_PAIR} FROM {{pred_sited}} a JOIN {{pred_sited}} b ON a.SSB = b.SSB AND a.SSBS < b.SSBS", "Observed Predicted residual")
def _(v):
    return e.delta_predictions(v("pred_site"), v("site_base"), "SSB", "Predicted")


_BASE = "{0}.Predominant_land_use = 'Primary vegetation' AND {0}.Use_intensity = 'Minimal use'"


@query(
    "delta_predictions_reference",
    f"SELECT a.SS, {_PAIR} FROM {{pred_sited}} a JOIN {{pred_sited}} b ON a.SS = b.SS AND {_BASE.format('a')} AND NOT ({_BASE.format('b')})",
    "Observed Predicted residual",
)
def _(v):
    return e.delta_predictions(v("pred_site"), v("site_base"), "SS", "Predicted", ref_only=True)


_CL = "greatest(least({0}, 1 - 1e-6), 1e-6)"
_LOGIT = "ln({0} / (1 - {0}))"
_FE, _RE = _CL.format("Predicted_FE"), _CL.format("Predicted_RE")
_V = f"var_samp({_LOGIT.format(_FE)}) AS vf, var_samp({_LOGIT.format(_RE)} - {_LOGIT.format(_FE)}) AS vr, avg(1 / (13e0 * {_RE} * (1 - {_RE}))) AS ve"


@query("variance_explained", f"SELECT model, vf / (vf + vr + ve) AS marginal_r2, (vf + vr) / (vf + vr + ve) AS conditional_r2 FROM (SELECT model, {_V} FROM {{predictions}} GROUP BY model) t", "marginal_r2 conditional_r2")
def _(v):
    return e.variance_explained(v("predictions"), "beta", 12.0, keys=["model"])


@query(
    "variance_explained_gaussian",
    "SELECT model, vf / (vf + vr + ve) AS marginal_r2, (vf + vr) / (vf + vr + ve) AS conditional_r2 FROM (SELECT model, var_samp(Predicted_FE) AS vf, var_samp(Predicted_RE - Predicted_FE) AS vr, var_samp(Observed - Predicted_RE) AS ve FROM {predictions} GROUP BY model) t",
    "marginal_r2 conditional_r2",
)
def _(v):
    return e.variance_explained(v("predictions"), "gaussian", keys=["model"])


@query(
    "bayesian_r2",
    'SELECT "Chain", "Draw", var_pop(Prediction) / (var_pop(Prediction) + var_pop(Observed - Prediction)) AS bayesian_r2 FROM {per_draw} d JOIN {pred_site} p ON d.SSBS = p.SSBS GROUP BY "Chain", "Draw"',
    "bayesian_r2",
)
def _(v):
    from ecoframe.operators.scoring import predictive_distribution

    draws = predictive_distribution(_observations(v), _draws(v), ["SSBS"], _X)
    return e.bayesian_r2(draws.join(v("pred_site").select("SSBS", "Observed"), "SSBS"))


@query(
    "calibration_by_group",
    "SELECT Biome, count(*) AS n, 1 - avg((Observed - Predicted) * (Observed - Predicted)) / var_pop(Observed) AS r2_std, var_pop(Predicted) / (var_pop(Predicted) + var_pop(Observed - Predicted)) AS r2_var, avg(Predicted - Observed) AS mean_residual, stddev_pop(Predicted - Observed) AS sd_residual FROM {pred_sited} GROUP BY Biome",
    "r2_std r2_var mean_residual sd_residual",
)
def _(v):
    return e.calibration_by_group(v("pred_sited"), "Biome")


# --- groups ---------------------------------------------------------------------------------


def outlier_sql(source: str, group: str, column: str) -> str:
    def flag(m: float) -> str:
        return f"({column} < q1 - {m}e0 * (q3 - q1) OR {column} > q3 + {m}e0 * (q3 - q1))"

    return f"""
        SELECT {group}, avg(CASE WHEN {flag(1.5)} THEN 1e0 ELSE 0e0 END) AS prop_outliers_1_5, count(*) FILTER ({flag(1.5)}) AS n_outliers_1_5,
          avg(CASE WHEN {flag(1.0)} THEN 1e0 ELSE 0e0 END) AS prop_outliers_1, count(*) FILTER ({flag(1.0)}) AS n_outliers_1
        FROM {source} JOIN (SELECT {group}, max(CASE WHEN rn - 1 = round((n - 1) * 0.25e0) THEN {column} END) AS q1, max(CASE WHEN rn - 1 = round((n - 1) * 0.75e0) THEN {column} END) AS q3
          FROM (SELECT {group}, {column}, row_number() OVER (PARTITION BY {group} ORDER BY {column}) AS rn, count(*) OVER (PARTITION BY {group}) AS n FROM {source}) t GROUP BY {group}) q USING ({group}) GROUP BY {group}"""


@query("outlier_share", outlier_sql("{pred_sited}", "SS", "Observed"), "prop_outliers_1_5 prop_outliers_1")
def _(v):
    return e.outlier_share(v("pred_sited"), "SS", "Observed")


def _nu(c: str) -> str:
    return f"count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)"


def taxa_sql(group: str) -> str:
    names = {'"Order"': "n_orders", "Family": "n_families", "Genus": "n_genera", "Species": "n_species"}
    return f"SELECT p.{group}, " + ", ".join(f"{_nu(c)} AS {n}" for c, n in names.items()) + f" FROM {{site_obs}} o JOIN {{site_base}} p ON o.SSBS = p.SSBS GROUP BY p.{group}"


@query("taxa_per_group", taxa_sql("Biome"))
def _(v):
    return e.taxa_per_group(v("site_obs"), v("site_base"), "Biome")


def distance_sql(columns: list[str], ranges: str, a: str = "a", b: str = "b") -> str:
    return "(" + " + ".join(f"abs({a}.{c} - {b}.{c}) / {ranges}.{c}" for c in columns) + f") / {len(columns)}"


_RANGE = "SELECT label, " + ", ".join(f"max({c}) - min({c}) AS {c}" for c in COVARIATE_NAMES) + " FROM {covariates} GROUP BY label"
PARTS["group_knn"] = f"""
    SELECT label, vec_id, median(d) AS gower_distance FROM (
      SELECT a.label, a.vec_id, {distance_sql(COVARIATE_NAMES, 'r')} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {distance_sql(COVARIATE_NAMES, 'r')}, b.vec_id) AS rn
      FROM {{covariates}} a JOIN {{covariates}} b ON a.label = b.label AND a.vec_id <> b.vec_id JOIN ({_RANGE}) r ON a.label = r.label) t WHERE rn <= 10 GROUP BY label, vec_id"""


@query("gower_knn_exact", "SELECT * FROM {group_knn}", "gower_distance")
def _(v):
    return e.gower_knn_exact(v("covariates"), ["label"], COVARIATE_NAMES, "vec_id", 10)


@query("gower_per_group", "SELECT label, avg(gower_distance) AS gower_mean, stddev_pop(gower_distance) AS gower_std, median(gower_distance) AS gower_median FROM {group_knn} GROUP BY label", "gower_mean gower_std gower_median")
def _(v):
    return e.gower_per_group(v("covariates"), "label", COVARIATE_NAMES, "vec_id", 10)


PARTS["drawn"] = "SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42' || vec_id), vec_id) AS rk FROM {covariates}"


@query(
    "gower_per_group_random",
    f"""SELECT label, avg(gd) AS gower_mean, stddev_pop(gd) AS gower_std, median(gd) AS gower_median FROM (
          SELECT label, vec_id, median(d) AS gd FROM (
            SELECT a.label, a.vec_id, {distance_sql(COVARIATE_NAMES, 'r')} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY b.rk) AS rn
            FROM {{covariates}} a JOIN {{drawn}} b ON a.label = b.label AND a.vec_id <> b.vec_id AND b.rk <= 11 JOIN ({_RANGE}) r ON a.label = r.label) t
          WHERE rn <= 10 GROUP BY label, vec_id) g GROUP BY label""",
    "gower_mean gower_std gower_median",
)
def _(v):
    return e.gower_per_group(v("covariates"), "label", COVARIATE_NAMES, "vec_id", 10, selection="random")


_RANGE_ALL = "SELECT " + ", ".join(f"max({c}) - min({c}) AS {c}" for c in COVARIATE_NAMES) + " FROM {covariates}"


@query(
    "gower_knn",
    f"""SELECT vec_id, median(d) AS gower_distance FROM (
          SELECT a.vec_id, {distance_sql(COVARIATE_NAMES, 'r')} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {distance_sql(COVARIATE_NAMES, 'r')}, b.vec_id) AS rn
          FROM {{covariates}} a JOIN {{covariates}} b ON a.vec_id <> b.vec_id CROSS JOIN ({_RANGE_ALL}) r) t WHERE rn <= 5 GROUP BY vec_id""",
    "gower_distance",
)
def _(v):
    c = v("covariates")
    return e.gower_knn(c, c, COVARIATE_NAMES, "vec_id", 5, same=True).select("vec_id", "gower_distance")


_RANGE_ROLE = "SELECT q.fold, q.role, " + ", ".join(f"greatest(q.h_{c}, r.h_{c}) - least(q.l_{c}, r.l_{c}) AS {c}" for c in COVARIATE_NAMES) + " FROM ({0}) q JOIN ({1}) r ON q.fold = r.fold"
_ENDS = ", ".join(f"max({c}) AS h_{c}, min({c}) AS l_{c}" for c in COVARIATE_NAMES)
PARTS["cov_roles"] = "SELECT c.*, k.fold, CASE WHEN c.Fold_id = k.fold THEN 'test' ELSE 'train' END AS role FROM {covariates} c CROSS JOIN (SELECT DISTINCT Fold_id AS fold FROM {covariates}) k"
PARTS["cov_refs"] = "SELECT * FROM {cov_roles} WHERE role = 'train'"


@query(
    "gower_train_test",
    f"""SELECT fold, role, vec_id, median(d) AS gower_distance FROM (
          SELECT a.fold, a.role, a.vec_id, {distance_sql(COVARIATE_NAMES, 'r')} AS d, row_number() OVER (PARTITION BY a.fold, a.role, a.vec_id ORDER BY {distance_sql(COVARIATE_NAMES, 'r')}, b.vec_id) AS rn
          FROM {{cov_roles}} a JOIN {{cov_refs}} b ON a.fold = b.fold AND a.vec_id <> b.vec_id
          JOIN ({_RANGE_ROLE.format(f'SELECT fold, role, {_ENDS} FROM {{cov_roles}} GROUP BY fold, role', f'SELECT fold, {_ENDS} FROM {{cov_refs}} GROUP BY fold')}) r ON a.fold = r.fold AND a.role = r.role) t
        WHERE rn <= 5 GROUP BY fold, role, vec_id""",
    "gower_distance",
)
def _(v):
    return e.gower_train_test(v("covariates"), COVARIATE_NAMES, "vec_id", 5, 5)


_GROUP_COV = COVARIATE_NAMES


@query(
    "group_summary",
    f"""SELECT s.Biome, n_sites, n_observations, n_studies, response_std, Pearson_r, ln(n_sites) AS n_sites_log, ln(n_observations) AS n_observations_log, ln(n_studies) AS n_studies_log,
          prop_outliers_1, n_outliers_1, n_orders, n_species, g.gower_mean FROM (
          SELECT Biome, count(DISTINCT SSBS) AS n_sites, count(*) AS n_observations, count(DISTINCT SS) AS n_studies, stddev_samp(Observed) AS response_std, {_CORR.format('Observed', 'Predicted')} AS Pearson_r FROM {{pred_sited}} GROUP BY Biome) s
        JOIN ({outlier_sql('{pred_sited}', 'Biome', 'Observed')}) o ON s.Biome = o.Biome
        JOIN (SELECT p.Biome, {_nu('"Order"')} AS n_orders, {_nu('Species')} AS n_species FROM {{site_obs}} t JOIN {{pred_sited}} p ON t.SSBS = p.SSBS GROUP BY p.Biome) x ON s.Biome = x.Biome
        LEFT JOIN (SELECT r_name AS Biome, avg(gower_distance) AS gower_mean FROM {{biome_knn}} JOIN {{region}} ON r_regionkey = label GROUP BY r_name) g ON s.Biome = g.Biome""",
    "response_std Pearson_r n_sites_log n_observations_log n_studies_log prop_outliers_1 gower_mean",
)
def _(v):
    region = v("region").select(F.col("r_regionkey").alias("label"), F.col("r_name").alias("Biome"))
    cov = v("covariates").join(region, "label")
    gower = e.gower_per_group(cov, "Biome", _GROUP_COV, "vec_id", 5)
    out = e.group_summary(v("pred_sited"), gower, v("site_obs"), "Biome")
    return out.select(
        "Biome", "n_sites", "n_observations", "n_studies", "response_std", "Pearson_r", "n_sites_log", "n_observations_log", "n_studies_log",
        "prop_outliers_1", "n_outliers_1", "n_orders", "n_species", "gower_mean",
    )


PARTS["biome_knn"] = f"""
    SELECT label, vec_id, median(d) AS gower_distance FROM (
      SELECT a.label, a.vec_id, {distance_sql(_GROUP_COV, 'r')} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {distance_sql(_GROUP_COV, 'r')}, b.vec_id) AS rn
      FROM {{covariates}} a JOIN {{covariates}} b ON a.label = b.label AND a.vec_id <> b.vec_id JOIN ({_RANGE}) r ON a.label = r.label) t WHERE rn <= 5 GROUP BY label, vec_id"""


# --- regressions, countries, intactness -----------------------------------------------------

_PRED3 = ["Latitude", "Longitude", "Observed"]
# Least squares on z-scores: the correlation matrix of up to three predictors is inverted in place.
_T = "1.959963984540054"
_QUANTILE = (
    f"({_T} + (pow({_T}, 3) + {_T}) / (4 * v) + (5 * pow({_T}, 5) + 16 * pow({_T}, 3) + 3 * {_T}) / (96 * v * v)"
    f" + (3 * pow({_T}, 7) + 19 * pow({_T}, 5) + 17 * pow({_T}, 3) - 15 * {_T}) / (384 * v * v * v))"
)


def ols_sql(xs: list[str]) -> str:
    p = len(xs)
    c = {(i, j): "1e0" if i == j else f"c{min(i, j)}{max(i, j)}" for i in range(3) for j in range(3)}
    if p == 1:
        inverse = {(0, 0): "1e0"}
    else:
        det = "(1 + 2 * c01 * c02 * c12 - c01 * c01 - c02 * c02 - c12 * c12)"
        inverse = {}
        for i in range(3):
            for j in range(3):
                a, b = [k for k in range(3) if k != i], [k for k in range(3) if k != j]
                sign = "" if (i + j) % 2 == 0 else "-"
                inverse[i, j] = f"({sign}({c[a[0], b[0]]} * {c[a[1], b[1]]} - {c[a[0], b[1]]} * {c[a[1], b[0]]}) / {det})"
    sums = [f"corr({xs[i]}, {xs[j]}) AS c{i}{j}" for i in range(p) for j in range(i + 1, p)]
    sums += [f"covar_samp({x}, Predicted) / stddev_samp({x}) AS q{i}" for i, x in enumerate(xs)]
    slopes = [" + ".join(f"{inverse[i, j]} * q{j}" for j in range(p)) + f" AS b{i}" for i in range(p)]
    variance = [f"{inverse[i, i]} AS d{i}" for i in range(p)]
    left = " + ".join(f"b{i} * q{i}" for i in range(p))
    rows = ["SELECT 'Intercept' AS term, my AS b, sqrt(s2 / n) AS e, v FROM fit"]
    rows += [f"SELECT '{x}', b{i}, sqrt(d{i} * s2 / (n - 1)), v FROM fit" for i, x in enumerate(xs)]
    return f"""
        SELECT term, b AS estimate, e AS std_error, b - t * e AS ci_lower, b + t * e AS ci_upper, CASE WHEN b - t * e > 0 OR b + t * e < 0 THEN '*' ELSE '' END AS significant
        FROM (WITH sums AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(Predicted) AS my, var_samp(Predicted) AS vy, {', '.join(sums)} FROM {{pred_sited}}),
          slopes AS (SELECT *, {', '.join(slopes + variance)} FROM sums),
          fit AS (SELECT *, n - {p + 1} AS v, (n - 1) * (vy - ({left})) / (n - {p + 1}) AS s2 FROM slopes)
          SELECT *, {_QUANTILE} AS t FROM ({' UNION ALL '.join(rows)}) r) o"""


_OLS = "estimate std_error ci_lower ci_upper"


@query("ols_standardised", ols_sql(["Latitude"]), _OLS)
def _(v):
    return e.ols_standardised(v("pred_sited"), "Predicted", ["Latitude"])


@query("ols_standardised_many", ols_sql(_PRED3), _OLS)
def _(v):
    return e.ols_standardised(v("pred_sited"), "Predicted", _PRED3)


@query(
    "polyfit",
    f"""SELECT CAST(i AS INT) AS i, lo + i * (hi - lo) / 199 AS x, a + b * (lo + i * (hi - lo) / 199) AS y, r AS pearson_r, mae
        FROM (SELECT min(Observed) AS lo, max(Observed) AS hi, regr_intercept(Predicted, Observed) AS a, regr_slope(Predicted, Observed) AS b, {_CORR.format('Observed', 'Predicted')} AS r, avg(abs(Observed - Predicted)) AS mae FROM {{pred_site}}) t, range(0, 200) g(i)""",
    "x y pearson_r mae",
)
def _(v):
    return e.polyfit(v("pred_site"), "Observed", "Predicted", 1)


# A cubic by orthogonal polynomials on the centred and scaled values.
_P1, _P2 = "(z - a1)", "((z - a2) * (z - a1) - b2)"
_P3 = f"((z - a3) * {_P2} - b3 * {_P1})"
PARTS["cubic_ends"] = f"SELECT min(Observed) AS lo, max(Observed) AS hi, {_CORR.format('Observed', 'Predicted')} AS r, avg(abs(Observed - Predicted)) AS mae FROM {{pred_site}}"
PARTS["cubic_z"] = "SELECT (Observed - (lo + hi) / 2) / ((hi - lo) / 2) AS z, Predicted AS y FROM {pred_site}, {cubic_ends}"
PARTS["cubic_1"] = "SELECT avg(z) AS a1, avg(y) AS k0 FROM {cubic_z}"
PARTS["cubic_2"] = f"SELECT a1, k0, sum(z * {_P1} * {_P1}) / sum({_P1} * {_P1}) AS a2, avg({_P1} * {_P1}) AS b2, sum(y * {_P1}) / sum({_P1} * {_P1}) AS k1 FROM {{cubic_z}}, {{cubic_1}} GROUP BY a1, k0"
PARTS["cubic_3"] = f"SELECT a1, a2, b2, k0, k1, sum(z * {_P2} * {_P2}) / sum({_P2} * {_P2}) AS a3, sum({_P2} * {_P2}) / sum({_P1} * {_P1}) AS b3, sum(y * {_P2}) / sum({_P2} * {_P2}) AS k2 FROM {{cubic_z}}, {{cubic_2}} GROUP BY a1, a2, b2, k0, k1"
PARTS["cubic_4"] = f"SELECT a1, a2, a3, b2, b3, k0, k1, k2, sum(y * {_P3}) / sum({_P3} * {_P3}) AS k3 FROM {{cubic_z}}, {{cubic_3}} GROUP BY a1, a2, a3, b2, b3, k0, k1, k2"


@query(
    "polyfit_cubic",
    f"""SELECT i, x, k0 + k1 * {_P1} + k2 * {_P2} + k3 * {_P3} AS y, r AS pearson_r, mae FROM (
          SELECT CAST(i AS INT) AS i, lo + i * (hi - lo) / 199 AS x, (lo + i * (hi - lo) / 199 - (lo + hi) / 2) / ((hi - lo) / 2) AS z, r, mae FROM {{cubic_ends}}, range(0, 200) g(i)) q, {{cubic_4}}""",
    "x y pearson_r mae",
)
def _(v):
    return e.polyfit(v("pred_site"), "Observed", "Predicted", 3)


PARTS["kde_values"] = "SELECT k.fold, CASE WHEN p.fold = k.fold THEN 'test' ELSE 'train' END AS role, Observed AS v FROM {predictions} p CROSS JOIN (SELECT DISTINCT fold FROM {predictions}) k"


@query(
    "kde_by_fold",
    """SELECT s.fold, s.role, CAST(i AS INT) AS i, lo + i * step AS x, sum(w * exp(-((lo + i * step - v) / h) * ((lo + i * step - v) / h) / 2) / (sqrt(2 * pi()) * h * n)) AS density
       FROM (SELECT fold, role, v, count(*) AS w FROM {kde_values} GROUP BY fold, role, v) s
       JOIN (SELECT fold, role, count(*) AS n, pow(count(*), -0.2e0) * stddev_samp(v) * 1.2e0 AS h FROM {kde_values} GROUP BY fold, role) b ON s.fold = b.fold AND s.role = b.role
       CROSS JOIN (SELECT min(v) - 0.05e0 * (max(v) - min(v)) AS lo, 1.1e0 * (max(v) - min(v)) / 199 AS step FROM {kde_values}) g, range(0, 200) t(i) GROUP BY s.fold, s.role, i, lo, step""",
    "x density",
)
def _(v):
    return e.kde_by_fold(v("predictions").withColumnRenamed("fold", "Fold_id"), "Observed", 5)


_COUNTRY = f"SELECT Country, CAST(count(DISTINCT SS) AS INT) AS Nb_of_studies, CAST(count(DISTINCT SSBS) AS INT) AS Nb_of_sites, greatest(least({_CORR.format('Observed', 'Predicted')}, 1), 0) AS Average_r FROM {{pred_sited}} GROUP BY Country"
PARTS["countries"] = _COUNTRY.replace("greatest(least(", "CASE WHEN true THEN greatest(least(").replace(", 1), 0) AS Average_r", ", 1e0), 0e0) END AS Average_r")


@query("country_stats", "SELECT * FROM {countries}", "Average_r")
def _(v):
    return e.country_stats(v("pred_sited"), clip=(0.0, 1.0))


@query("country_filter_percentiles", "SELECT quantile_cont(Average_r, 0.05) AS perc_5, quantile_cont(Average_r, 0.95) AS perc_95 FROM {countries} WHERE Nb_of_sites >= 25 AND Nb_of_studies >= 1", "perc_5 perc_95")
def _(v):
    return e.country_filter_percentiles(e.country_stats(v("pred_sited"), clip=(0.0, 1.0)), min_studies=1)


_REF = "Predominant_land_use = 'Primary vegetation' AND Use_intensity = 'Minimal use'"


@query(
    "intactness",
    f"""SELECT p.SSBS, p.SS, CASE WHEN Predicted = 0 OR Reference_pred = 0 THEN 0 ELSE least(Predicted / Reference_pred, 3) END AS Predicted_scaled,
          CASE WHEN Observed = 0 OR m = 0 THEN 0 ELSE least(Observed / m, 3) END AS Observed_scaled, CASE WHEN Predicted = 0 OR Reference_pred = 0 THEN 0 ELSE least(Predicted / Reference_pred, 1) END AS Predicted_scaled_capped
        FROM {{pred_sited}} p JOIN (SELECT SS, count(*) AS n FROM {{site_base}} WHERE {_REF} GROUP BY SS HAVING count(*) >= 5) k ON p.SS = k.SS
        LEFT JOIN (SELECT SS, avg(Observed) AS m FROM {{pred_sited}} WHERE {_REF} GROUP BY SS) r ON p.SS = r.SS""",
    "Predicted_scaled Observed_scaled Predicted_scaled_capped",
)
def _(v):
    out = e.intactness(v("pred_site"), v("site_base"), 5)
    return out.select("SSBS", "SS", "Predicted_scaled", "Observed_scaled", "Predicted_scaled_capped")


# --- several runs in one plan ---------------------------------------------------------------

_RUN = ["model", "mode"]
_RUNS = "model, mode"
PARTS["run_sites"] = """
    SELECT model, mode, SSBS, avg(Observed) AS Observed, avg(Predicted_FE) AS Predicted, avg(Reference_pred_FE) AS Reference_pred
    FROM {predictions} GROUP BY model, mode, SSBS"""
PARTS["run_sited"] = "SELECT r.*, b.SS, b.SSB, b.Biome, b.Country, b.Predominant_land_use, b.Use_intensity FROM {run_sites} r JOIN {site_base} b ON r.SSBS = b.SSBS"


def _run_sites(v):
    means = [F.avg("Observed").alias("Observed"), F.avg("Predicted_FE").alias("Predicted"), F.avg("Reference_pred_FE").alias("Reference_pred")]
    return v("predictions").groupBy(*_RUN, "SSBS").agg(*means)


def _run_sited(v):
    site = v("site_base").select("SSBS", "SS", "SSB", "Biome", "Country", "Predominant_land_use", "Use_intensity")
    return _run_sites(v).join(site, "SSBS")


_RUN_TENTH = f"CAST(ceil(10 * row_number() OVER (PARTITION BY {_RUNS} ORDER BY Observed, {_BY}) / count(*) OVER (PARTITION BY {_RUNS})) AS INT)"
_RUN_QUARTER = f"ceil(4 * row_number() OVER (PARTITION BY {_RUNS} ORDER BY Observed, {_BY}) / count(*) OVER (PARTITION BY {_RUNS})) - 1"
_SECTIONS = ", ".join(f"'{x}'" for x in ["overall", "bottom_quartile", "top_quartile", *[f"decile_{i}" for i in range(1, 11)]])


@query(
    "bias_ratios_runs",
    f"""SELECT k.model, k.mode, k.section, coalesce(n, 0) AS n, bias_ratio FROM (SELECT * FROM (SELECT DISTINCT {_RUNS} FROM {{predictions}}) r CROSS JOIN (SELECT unnest([{_SECTIONS}]) AS section) x) k LEFT JOIN (
        SELECT {_RUNS}, section, count(*) AS n, {_BIAS} FROM (
          SELECT {_RUNS}, 'overall' AS section, Observed, Predicted_FE FROM {{predictions}}
          UNION ALL SELECT {_RUNS}, CASE q WHEN 0 THEN 'bottom_quartile' ELSE 'top_quartile' END, Observed, Predicted_FE FROM (SELECT *, {_RUN_QUARTER} AS q FROM {{predictions}}) a WHERE q IN (0, 3)
          UNION ALL SELECT {_RUNS}, 'decile_' || {_RUN_TENTH}, Observed, Predicted_FE FROM {{predictions}}) u GROUP BY {_RUNS}, section) c
        ON k.model = c.model AND k.mode = c.mode AND k.section = c.section""",
    "bias_ratio",
)
def _(v):
    return e.bias_ratios(v("predictions"), _TIES, "Predicted_FE", keys=_RUN)


@query(
    "calibration_by_group_runs",
    f"SELECT {_RUNS}, Biome, count(*) AS n, CASE WHEN var_pop(Observed) > 0 THEN 1 - avg((Observed - Predicted) * (Observed - Predicted)) / var_pop(Observed) END AS r2_std, var_pop(Predicted) / (var_pop(Predicted) + var_pop(Observed - Predicted)) AS r2_var, avg(Predicted - Observed) AS mean_residual, stddev_pop(Predicted - Observed) AS sd_residual FROM {{run_sited}} GROUP BY {_RUNS}, Biome",
    "r2_std r2_var mean_residual sd_residual",
)
def _(v):
    site = v("site_base").select("SSBS", "Biome")
    # Written, so that no task holds the means per site together with their join.
    return e.calibration_by_group(materialise(_run_sites(v), "runs").join(site, "SSBS"), "Biome", keys=_RUN)


@query("outlier_share_runs", outlier_sql("{run_sited}", f"{_RUNS}, SS", "Observed"), "prop_outliers_1_5 prop_outliers_1")
def _(v):
    return e.outlier_share(_run_sited(v), "SS", "Observed", keys=_RUN)


@query(
    "country_stats_runs",
    f"""SELECT c.*, CASE WHEN l.iso_a3 <> '-99' THEN l.iso_a3 END AS iso_a3, l.country_std FROM (
          SELECT {_RUNS}, Country, CAST(count(DISTINCT SS) AS INT) AS Nb_of_studies, CAST(count(DISTINCT SSBS) AS INT) AS Nb_of_sites, CASE WHEN true THEN greatest(least({_CORR.format('Observed', 'Predicted')}, 1e0), 0e0) END AS Average_r
          FROM {{run_sited}} GROUP BY {_RUNS}, Country) c LEFT JOIN {{country_lookup}} l ON c.Country = l.country_std""",
    "Average_r",
)
def _(v):
    return e.country_stats(_run_sited(v), clip=(0.0, 1.0), keys=_RUN, lookup=v("country_lookup"))


@query(
    "intactness_runs",
    f"""SELECT p.model, p.mode, p.SSBS, CASE WHEN Predicted = 0 OR Reference_pred = 0 THEN 0 ELSE least(Predicted / Reference_pred, 3) END AS Predicted_scaled,
          CASE WHEN Observed = 0 OR m = 0 THEN 0 ELSE least(Observed / m, 3) END AS Observed_scaled
        FROM {{run_sited}} p JOIN (SELECT SS FROM {{site_base}} WHERE {_REF} GROUP BY SS HAVING count(*) >= 5) k ON p.SS = k.SS
        LEFT JOIN (SELECT {_RUNS}, SS, avg(Observed) AS m FROM {{run_sited}} WHERE {_REF} GROUP BY {_RUNS}, SS) r ON p.model = r.model AND p.mode = r.mode AND p.SS = r.SS""",
    "Predicted_scaled Observed_scaled",
)
def _(v):
    # Read for the reference means and again for the rows.
    return e.intactness(materialise(_run_sites(v), "runs"), v("site_base"), 5, keys=_RUN).select(*_RUN, "SSBS", "Predicted_scaled", "Observed_scaled")


@query(
    "delta_predictions_runs",
    f"SELECT a.model, a.mode, a.SSB, {_PAIR} FROM {{run_sited}} a JOIN {{run_sited}} b ON a.model = b.model AND a.mode = b.mode AND a.SSB = b.SSB AND a.SSBS < b.SSBS",
    "Observed Predicted residual",
)
def _(v):
    return e.delta_predictions(_run_sites(v), v("site_base"), "SSB", "Predicted", keys=_RUN)


PARTS["taxon_sites"] = "SELECT SSBS, 'T' || l_partkey % 3 AS taxon, avg(Observed) AS Observed, avg(Predicted_FE) AS Predicted FROM {predictions} GROUP BY SSBS, l_partkey % 3"
PARTS["taxon_sited"] = "SELECT t.*, b.SSB, b.Predominant_land_use, b.Use_intensity FROM {taxon_sites} t JOIN {site_base} b ON t.SSBS = b.SSBS"


@query(
    "delta_predictions_taxon",
    f"SELECT a.SSB, a.taxon, {_PAIR} FROM {{taxon_sited}} a JOIN {{taxon_sited}} b ON a.taxon = b.taxon AND a.SSB = b.SSB AND a.SSBS < b.SSBS",
    "Observed Predicted residual",
)
def _(v):
    taxon = F.concat(F.lit("T"), F.col("l_partkey") % 3).alias("taxon")
    rows = v("predictions").groupBy("SSBS", taxon).agg(F.avg("Observed").alias("Observed"), F.avg("Predicted_FE").alias("Predicted"))
    return e.delta_predictions(rows, v("site_base"), "SSB", "Predicted", taxon="taxon")
