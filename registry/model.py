from __future__ import annotations

from pyspark.sql import functions as F

from ecoframe.operators import folds as fo, hierarchy as h, joins as j, ranking, scope as s
from ecoframe.plans import model_data
from ecoframe.session import materialise
from registry.base import PARTS, query
from registry.diversity import alpha, alpha_input, beta
from registry.transforms import site_features

_TAX = "Custom_taxonomic_group"

# --- scope ----------------------------------------------------------------------------------


@query("scope_counts", f"SELECT count(DISTINCT SS) AS studies, count(*) AS observations, count(DISTINCT SSBS) AS sites, count(DISTINCT {_TAX}) AS check_key FROM {{obs_groups}}")
def _(v):
    return s.scope_counts(v("obs_groups"), "alpha", _TAX)


@query("scope_counts_pairs", "SELECT count(DISTINCT SS) AS studies, count(*) AS observations, count(*) AS site_pairs FROM {pairs}")
def _(v):
    return j.reference_pair_counts(v("site_obs"))


PARTS["site_total"] = "SELECT SS, SSBS, sum(Measurement) AS total FROM {site_obs} GROUP BY SS, SSBS"
PARTS["outlier_bounds"] = """
    SELECT SS, q3 + 0.5e0 * (q3 - q1) AS upper FROM (
      SELECT SS, max(CASE WHEN rn - 1 = round((n - 1) * 0.25e0) THEN total END) AS q1, max(CASE WHEN rn - 1 = round((n - 1) * 0.75e0) THEN total END) AS q3
      FROM (SELECT SS, total, row_number() OVER (PARTITION BY SS ORDER BY total) AS rn, count(*) OVER (PARTITION BY SS) AS n FROM {site_total}) t GROUP BY SS) q"""
PARTS["no_outliers"] = "SELECT t.SS, t.SSBS, t.total FROM {site_total} t JOIN {outlier_bounds} b ON t.SS = b.SS WHERE t.total <= b.upper"


def _site_total(v):
    return v("site_obs").groupBy("SS", "SSBS").agg(F.sum("Measurement").alias("total"))


@query("filter_outliers_iqr", "SELECT * FROM {no_outliers}", "total")
def _(v):
    return s.filter_outliers_iqr(_site_total(v), "total", 0.5, ["SSBS"])


@query("filter_small_studies", "SELECT SS, SSBS, total FROM {site_total} WHERE SS IN (SELECT SS FROM {site_total} GROUP BY SS HAVING count(SSBS) >= 60)", "total")
def _(v):
    return s.filter_small_studies(_site_total(v), 60)


@query(
    "filter_few_reference_sites",
    """SELECT SS, SSBS, Predominant_land_use FROM {site_base} WHERE SS IN (SELECT SS FROM {site_base}
       WHERE Predominant_land_use = 'Primary vegetation' AND Use_intensity = 'Minimal use' GROUP BY SS HAVING count(DISTINCT SSBS) >= 5)""",
)
def _(v):
    from ecoframe.operators.transforms import land_use_intensity

    df = land_use_intensity(v("site_base").select("SS", "SSBS", "Predominant_land_use", "Use_intensity"))
    return s.filter_few_reference_sites(df, 5).select("SS", "SSBS", "Predominant_land_use")


@query(
    "scope_change_report",
    """SELECT 'studies' AS quantity, b.st AS before, a.st AS after, b.st - a.st AS dropped FROM {change_b} b, {change_a} a
       UNION ALL SELECT 'observations', b.ob, a.ob, b.ob - a.ob FROM {change_b} b, {change_a} a
       UNION ALL SELECT 'sites', b.si, a.si, b.si - a.si FROM {change_b} b, {change_a} a""",
)
def _(v):
    df = v("site_obs")
    return s.scope_change_report(df, df.filter(F.col("Predominant_land_use") != "Cannot decide"), "alpha")


PARTS["change_b"] = "SELECT count(DISTINCT SS) AS st, count(*) AS ob, count(DISTINCT SSBS) AS si FROM {site_obs}"
PARTS["change_a"] = "SELECT count(DISTINCT SS) AS st, count(*) AS ob, count(DISTINCT SSBS) AS si FROM {site_obs} WHERE Predominant_land_use <> 'Cannot decide'"

# All-species alpha table in, filter chain, scope table by species group out.
PARTS["alpha0"] = """SELECT SS, SSBS, exp(avg(ln(Effort_corrected_measurement + 1))) - 1 AS g, any_value(Predominant_land_use) AS lu, any_value(Biome) AS Biome
    FROM {obs_groups} WHERE Diversity_metric_type = 'Abundance' GROUP BY SS, SSBS"""
PARTS["scope0"] = """SELECT *, CASE WHEN m = 0 THEN 0 ELSE g / m END AS y FROM (SELECT *, max(g) OVER (PARTITION BY SS) AS m FROM {alpha0}) a
    WHERE Biome <> 'ASIA' AND lu <> 'Cannot decide'"""
PARTS["scope1"] = """SELECT c.* FROM {scope0} c JOIN (
      SELECT SS, max(CASE WHEN rn - 1 = round((n - 1) * 0.75e0) THEN y END) + 0.5e0 * (max(CASE WHEN rn - 1 = round((n - 1) * 0.75e0) THEN y END)
        - max(CASE WHEN rn - 1 = round((n - 1) * 0.25e0) THEN y END)) AS upper
      FROM (SELECT SS, y, row_number() OVER (PARTITION BY SS ORDER BY y) AS rn, count(*) OVER (PARTITION BY SS) AS n FROM {scope0}) t GROUP BY SS) b
    ON c.SS = b.SS WHERE y <= upper"""


def _settings():
    return s.ScopeSettings(
        diversity_type="alpha", response="Scaled_Geometric_mean_abundance", biogeographic=("exclude", {"Biome": ["ASIA"]}),
        iqr_multiplier=0.5, min_sites_per_study=4,
    )


def _alpha_tables(v):
    keep = ["Scaled_Geometric_mean_abundance", "Predominant_land_use", "Use_intensity", "Biome"]
    # The observations are read four times.
    obs = materialise(alpha_input(v), "observations")
    # The diversity tables are stored results in the pipeline.
    return (
        materialise(alpha(v, 0, obs).select("SS", "SSB", "SSBS", *keep)),
        materialise(alpha(v, 1, obs).select("SS", "SSB", "SSBS", _TAX, *keep)),
    )


@query(
    "model_scope",
    f"SELECT SS, SSBS, {_TAX}, Scaled_Geometric_mean_abundance FROM {{alpha}} WHERE SSBS IN (SELECT SSBS FROM {{scope1}} WHERE SS IN (SELECT SS FROM {{scope1}} GROUP BY SS HAVING count(*) >= 4)) AND Scaled_Geometric_mean_abundance IS NOT NULL",
    "Scaled_Geometric_mean_abundance",
)
def _(v):
    everything, groups = _alpha_tables(v)
    return s.model_scope(everything, groups, _settings()).select("SS", "SSBS", _TAX, "Scaled_Geometric_mean_abundance")


@query("model_scope_pairs")
def _(v):
    checked = ["Road_density_1km", "Elevation_1km"]
    # The table is read several times; the distances, which no step reads, are not kept.
    pairs = materialise(beta(v).select("SS", "SSBS", "Primary_minimal_site", "Predominant_land_use", "Bray_Curtis_score", *checked))
    settings = s.ScopeSettings(
        diversity_type="beta", response="Bray_Curtis_score", checked_columns=checked,
        require_intensity=False, fraction=0.5, k_min=10, k_max=400, pairs_once=True,
    )
    return s.model_scope(pairs, None, settings).select("SS", "SSBS", "Primary_minimal_site", "Bray_Curtis_score")


# --- ranks ----------------------------------------------------------------------------------


_TIES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_BY = ", ".join(_TIES)


@query(
    "rank_bins",
    f"SELECT {_BY}, Observed, CAST(ceil(4 * rn / n) - 1 AS INT) AS bin FROM (SELECT *, row_number() OVER (ORDER BY Observed, {_BY}) AS rn, count(*) OVER () AS n FROM {{predictions}}) t",
    "Observed",
)
def _(v):
    return ranking.rank_bins(v("predictions").select(*_TIES, "Observed"), "Observed", 4, _TIES)


@query(
    "average_rank",
    f"SELECT {_BY}, Observed, rank() OVER (ORDER BY Observed) + (count(*) OVER (PARTITION BY Observed) - 1) / 2 AS avg_rank FROM {{predictions}}",
    "Observed avg_rank",
)
def _(v):
    return ranking.average_rank(v("predictions").select(*_TIES, "Observed"), "Observed")


@query("dense_index", "SELECT SSBS, CAST(row_number() OVER (ORDER BY SSBS) - 1 AS INT) AS idx FROM (SELECT DISTINCT SSBS FROM {site_obs}) t")
def _(v):
    return ranking.dense_index(v("site_obs"), "SSBS")


# --- hierarchy ------------------------------------------------------------------------------

LEVELS = {"level_1": ["Biome", _TAX], "level_2": ["Realm"], "level_3": []}
_L1, _L2 = f"Biome_{_TAX}", f"Biome_{_TAX}_Realm"
# A null realm for one realm, so that incomplete labels are dropped.
PARTS["labelled"] = f"""
    SELECT *, Biome || '_' || {_TAX} AS {_L1}, Biome || '_' || {_TAX} || '_' || Realm AS {_L2}
    FROM (SELECT SS, SSB, SSBS, Biome, {_TAX}, CASE WHEN Realm = 'R2' AND Biome = 'ASIA' THEN NULL ELSE Realm END AS Realm FROM
      (SELECT DISTINCT SS, SSB, SSBS, Biome, Realm, {_TAX} FROM {{obs_groups}}) o) x WHERE Realm IS NOT NULL"""
MIN_STUDIES = 2


def _labels(rows):
    realm = F.when(~((F.col("Realm") == "R2") & (F.col("Biome") == "ASIA")), F.col("Realm"))
    return h.hierarchy_labels(rows.withColumn("Realm", realm), LEVELS)


def _labelled(v):
    # Species groups are reduced per site before the site's own columns, which follow from it, join them.
    groups = v("obs_groups").select("SSBS", _TAX).distinct()
    sites = v("site_base").select("SS", "SSB", "SSBS", "Biome", "Realm").distinct()
    return _labels(sites.join(groups, "SSBS").select("SS", "SSB", "SSBS", "Biome", "Realm", _TAX))


def labelled(v):
    return materialise(_labelled(v))


@query("hierarchy_labels", "SELECT * FROM {labelled}")
def _(v):
    return _labelled(v)


PARTS["mapping"] = f"""
    SELECT 'level_1' AS level, {_L1} AS label, CAST(row_number() OVER (ORDER BY {_L1}) - 1 AS INT) AS idx, count(DISTINCT SS) AS n_studies, CAST(NULL AS VARCHAR) AS parent FROM {{labelled}} GROUP BY {_L1}
    UNION ALL SELECT 'level_2', {_L2}, CAST(row_number() OVER (ORDER BY {_L2}) - 1 AS INT), count(DISTINCT SS), min({_L1}) FROM {{labelled}} GROUP BY {_L2}"""


@query("hierarchy_mapping", "SELECT * FROM {mapping}")
def _(v):
    return h.hierarchy_mapping(labelled(v), LEVELS)


PARTS["rolled0"] = f"""
    SELECT l.*, CASE WHEN n2 >= {MIN_STUDIES} THEN {_L2} WHEN n1 >= {MIN_STUDIES} THEN {_L1} END AS g, CASE WHEN n2 >= {MIN_STUDIES} THEN 'level_2' WHEN n1 >= {MIN_STUDIES} THEN 'level_1' END AS lv
    FROM {{labelled}} l JOIN (SELECT {_L1}, count(DISTINCT SS) AS n1 FROM {{labelled}} GROUP BY {_L1}) a USING ({_L1}) JOIN (SELECT {_L2}, count(DISTINCT SS) AS n2 FROM {{labelled}} GROUP BY {_L2}) b USING ({_L2})"""
PARTS["rolled"] = f"""
    SELECT r.* EXCLUDE (g, lv), CASE WHEN c.n >= {MIN_STUDIES} THEN r.g ELSE 'Population' END AS Final_hierarchical_group,
      CASE WHEN c.n >= {MIN_STUDIES} THEN r.lv ELSE 'Population' END AS Final_hierarchical_level,
      CASE WHEN c.n >= {MIN_STUDIES} AND r.lv = 'level_2' THEN 0 ELSE 1 END AS Rolled_up
    FROM {{rolled0}} r LEFT JOIN (SELECT g, count(DISTINCT SS) AS n FROM {{rolled0}} GROUP BY g) c ON r.g = c.g"""


@query("hierarchical_rollup", "SELECT * FROM {rolled}")
def _(v):
    return h.hierarchical_rollup(labelled(v), LEVELS, MIN_STUDIES)


PARTS["rollup_groups"] = f"""
    SELECT 'level_1' AS level, label, late FROM (
      SELECT DISTINCT Final_hierarchical_group AS label, 0 AS late FROM {{rolled}} WHERE Final_hierarchical_level = 'level_1'
      UNION ALL SELECT DISTINCT {_L1}, 1 FROM {{rolled}} WHERE Final_hierarchical_level = 'level_2'
        AND {_L1} NOT IN (SELECT Final_hierarchical_group FROM {{rolled}} WHERE Final_hierarchical_level = 'level_1')) t
    UNION ALL SELECT DISTINCT 'level_2', Final_hierarchical_group, 0 FROM {{rolled}} WHERE Final_hierarchical_level = 'level_2'"""


@query(
    "rollup_mapping",
    f"""SELECT g.level, g.label, CAST(row_number() OVER (PARTITION BY g.level ORDER BY g.late, g.label) - 1 AS INT) AS idx, p.parent FROM {{rollup_groups}} g
        LEFT JOIN (SELECT Final_hierarchical_group AS label, min({_L1}) AS parent FROM {{rolled}} WHERE Final_hierarchical_level = 'level_2' GROUP BY 1) p ON g.level = 'level_2' AND g.label = p.label
        UNION ALL SELECT DISTINCT 'Population', 'None', 0, CAST(NULL AS VARCHAR) FROM {{rolled}} WHERE Final_hierarchical_level = 'Population'""",
)
def _(v):
    # Final groups follow from labels and studies alone, so no row per site is made.
    combos = materialise(_labels(v("obs_groups").select("SS", "Biome", "Realm", _TAX).distinct()), "combos")
    return h.rollup_mapping(materialise(h.hierarchical_rollup(combos, LEVELS, MIN_STUDIES)), LEVELS)


def _index(column: str) -> str:
    return f"CAST(dense_rank() OVER (ORDER BY {column}) - 1 AS INT)"


@query(
    "model_index_columns",
    f"""SELECT SS, SSB, SSBS, {_TAX}, {_index(_L1)} AS level_1_idx, {_index(_L2)} AS level_2_idx,
          CASE Final_hierarchical_level WHEN 'level_2' THEN 2 WHEN 'level_1' THEN 1 ELSE 0 END AS level_assignment,
          {_index('SS')} AS study_idx, {_index('SSB')} AS block_idx, {_index('SSBS')} AS site_idx, {_index(_TAX)} AS taxon_idx, {_index('SS')} AS block_to_study_idx FROM {{rolled}}""",
)
def _(v):
    rolled = materialise(h.hierarchical_rollup(labelled(v), LEVELS, MIN_STUDIES))
    out = h.model_index_columns(rolled, h.hierarchy_mapping(rolled, LEVELS), LEVELS, _TAX)
    names = ["level_1_idx", "level_2_idx", "level_assignment", "study_idx", "block_idx", "site_idx", "taxon_idx", "block_to_study_idx"]
    return out.select("SS", "SSB", "SSBS", _TAX, *names)


# --- folds ----------------------------------------------------------------------------------


@query("stratum", "SELECT SSBS, Biome, Realm, Biome || '_' || Realm AS Stratum FROM {site_base}")
def _(v):
    return fo.stratum(v("site_base").select("SSBS", "Biome", "Realm"), ["Biome", "Realm", None])


@query("small_strata", "SELECT Stratum, count(DISTINCT SS) AS n_groups FROM (SELECT SS, Biome || '_' || Realm AS Stratum FROM {site_base}) t GROUP BY Stratum HAVING count(DISTINCT SS) < 2")
def _(v):
    return fo.small_strata(fo.stratum(v("site_base").select("SS", "Biome", "Realm"), ["Biome", "Realm"]), 2, "SS")


PARTS["folded"] = """
    SELECT o.SS, o.SSBS, o.Biome AS Stratum, o.Taxon_name_entered, CAST(CASE WHEN p % 10 < 5 THEN p % 10 ELSE 9 - p % 10 END AS INT) AS Fold_id FROM {site_obs} o JOIN (
      SELECT SS, row_number() OVER (ORDER BY st, n DESC, md5('42' || SS), SS) - 1 AS p FROM (
        SELECT SS, CAST(sum(n) AS BIGINT) AS n, arg_min(Biome, (-n, Biome)) AS st FROM (SELECT SS, Biome, count(*) AS n FROM {site_obs} GROUP BY SS, Biome) c GROUP BY SS) g) f ON o.SS = f.SS"""


@query("assign_folds", "SELECT * FROM {folded}")
def _(v):
    df = fo.stratum(v("site_obs").select("SS", "SSBS", "Biome", "Taxon_name_entered"), ["Biome"]).drop("Biome")
    return fo.assign_folds(df, 5, "SS")


@query("train_test", "SELECT l_orderkey, l_linenumber, fold, Observed, role FROM (SELECT *, 'train' AS role FROM {predictions} WHERE fold <> 2 UNION ALL SELECT *, 'test' AS role FROM {predictions} WHERE fold = 2) t", "Observed")
def _(v):
    df = v("predictions").select("l_orderkey", "l_linenumber", F.col("fold").alias("Fold_id"), "Observed")
    train, test = fo.train_test(df, 2)
    return train.withColumn("role", F.lit("train")).unionByName(test.withColumn("role", F.lit("test"))).withColumnRenamed("Fold_id", "fold")


@query(
    "site_info",
    f"""SELECT SSBS, {_TAX}, Longitude, Country, Biome AS Stratum FROM (SELECT *, row_number() OVER (PARTITION BY SSBS, {_TAX} ORDER BY Taxon_name_entered) AS rn FROM {{obs_groups}}) t WHERE rn = 1""",
    "Longitude",
)
def _(v):
    df = fo.stratum(v("obs_groups"), ["Biome"])
    return fo.site_info(df, ["Longitude", "Country"], ["SSBS", _TAX], ["Taxon_name_entered"], strata=True)


_SCALED = ["Road_density_1km", "Elevation_1km"]


def _z(c: str, where: str) -> str:
    return f"coalesce(({c} - (SELECT avg({c}) FROM {{scaling}} WHERE {where})) / (SELECT stddev_pop({c}) FROM {{scaling}} WHERE {where}), NULL) AS {c}"


PARTS["scaling"] = "SELECT SSBS, CAST(c_custkey % 5 AS INT) AS Fold_id, Road_density_1km, Elevation_1km FROM {site_features}"


@query("standardise", "SELECT SSBS, Fold_id, " + ", ".join(_z(c, "Fold_id <> 1") for c in _SCALED) + " FROM {scaling} WHERE Fold_id = 1", _SCALED)
def _(v):
    df = site_features(v).select("SSBS", (F.col("c_custkey") % 5).cast("int").alias("Fold_id"), *_SCALED)
    return fo.standardise(*fo.train_test(df, 1), _SCALED)[1]


@query(
    "standardise_folds",
    "SELECT s.SSBS, s.Fold_id, f.fold, CASE WHEN f.fold = s.Fold_id THEN 'test' ELSE 'train' END AS role, "
    + ", ".join(f"(s.{c} - f.m_{c}) / f.s_{c} AS {c}" for c in _SCALED)
    + " FROM {scaling} s CROSS JOIN (SELECT k.fold, "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _SCALED)
    + " FROM (SELECT DISTINCT Fold_id AS fold FROM {scaling}) k JOIN {scaling} t ON t.Fold_id <> k.fold GROUP BY k.fold) f",
    _SCALED,
)
def _(v):
    df = site_features(v).select("SSBS", (F.col("c_custkey") % 5).cast("int").alias("Fold_id"), *_SCALED)
    return fo.standardise_folds(df, _SCALED, 5)


@query("model_table")
def _(v):
    everything, groups = _alpha_tables(v)
    realm = v("site_base").select("SSBS", "Realm")
    table = model_data.model_table(
        everything, groups.join(realm, "SSBS"), _settings(), LEVELS, MIN_STUDIES
    )
    return model_data.fold_data(table, 5, "study", ["Biome"]).select(
        "SS", "SSBS", _TAX, "Scaled_Geometric_mean_abundance", "Final_hierarchical_group", "Stratum", "Fold_id"
    )
