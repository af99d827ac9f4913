from __future__ import annotations

from pyspark.sql import functions as F

from ecoframe import config
from ecoframe.operators import diversity as d, joins as j
from ecoframe.session import materialise
from registry.base import PARTS, query
from registry.transforms import site_features, transform_sql

_Y = "Effort_corrected_measurement"
_AB = "Diversity_metric_type = 'Abundance'"
_TAX = "Custom_taxonomic_group"


def metric_sql(keys: str, tax: str, name: str, value: str, where: str) -> str:
    """A metric with its study maximum and scaled value, through windows."""
    part = "SS" + (f", {tax}" if tax else "")
    source = "{obs_groups}" if tax else "{site_obs}"
    return (
        f"SELECT {keys}, {name}, max({name}) OVER (PARTITION BY {part}) AS Study_max_{name}, "
        f"CASE WHEN max({name}) OVER (PARTITION BY {part}) = 0 THEN 0 ELSE {name} / max({name}) OVER (PARTITION BY {part}) END AS Scaled_{name} "
        f"FROM (SELECT {keys}, {value} AS {name} FROM {source} {where} GROUP BY {keys}) m"
    )


def scaled(name: str) -> list[str]:
    return [name, f"Study_max_{name}", f"Scaled_{name}"]


_KEYS = "SS, SSB, SSBS"
_FUN = {
    "total_abundance": ("Total_abundance", f"coalesce(sum({_Y}), 0)", f"WHERE {_AB}", d.total_abundance),
    "mean_abundance": ("Mean_abundance", f"avg({_Y})", f"WHERE {_AB}", d.mean_abundance),
    "geometric_mean_abundance": ("Geometric_mean_abundance", f"exp(avg(ln({_Y} + 1))) - 1", "", d.geometric_mean_abundance),
    "species_richness": ("Species_richness", f"CAST(sum(CASE WHEN {_Y} > 0 THEN 1 ELSE 0 END) AS BIGINT)", f"WHERE {_AB}", d.species_richness),
}


def _register(name, column, value, where, fn):
    keys = config.SITE_KEYS + [_TAX]
    doubles = scaled(column) if column != "Species_richness" else [f"Scaled_{column}"]

    @query(name, metric_sql(f"{_KEYS}, {_TAX}", _TAX, column, value, where), doubles)
    def _(v):
        return fn(v("obs_groups"), keys)


for _name, _args in _FUN.items():
    _register(_name, *_args)

# Shannon in the textbook form, with totals and richness joined back to the rows.
PARTS["shannon_rows"] = f"""
    SELECT o.SS, o.SSB, o.SSBS, o.{_TAX}, t.total, CASE WHEN t.rich = 1 THEN 0 WHEN t.total = 0 THEN 0
        WHEN {_Y} = 0 THEN 0 ELSE -({_Y} / t.total) * ln({_Y} / t.total) END AS comp
    FROM {{obs_groups}} o JOIN (SELECT SSBS, {_TAX}, coalesce(sum({_Y}), 0) AS total, sum(CASE WHEN {_Y} > 0 THEN 1 ELSE 0 END) AS rich
        FROM {{obs_groups}} WHERE {_AB} GROUP BY SSBS, {_TAX}) t ON o.SSBS = t.SSBS AND o.{_TAX} = t.{_TAX}"""
PARTS["shannon"] = f"SELECT SS, SSB, SSBS, {_TAX}, sum(comp) AS Shannon_index, ln(any_value(total) + 1) * sum(comp) AS Modified_Shannon_index FROM {{shannon_rows}} GROUP BY SS, SSB, SSBS, {_TAX}"


def scale_sql(columns: list[str], part: str) -> str:
    return ", ".join(
        f"{c}, max({c}) OVER (PARTITION BY {part}) AS Study_max_{c}, CASE WHEN max({c}) OVER (PARTITION BY {part}) = 0 THEN 0 "
        f"ELSE {c} / max({c}) OVER (PARTITION BY {part}) END AS Scaled_{c}"
        for c in columns
    )


@query(
    "shannon_index",
    f"SELECT SS, SSB, SSBS, {_TAX}, {scale_sql(['Shannon_index', 'Modified_Shannon_index'], 'SS, ' + _TAX)} FROM {{shannon}}",
    scaled("Shannon_index") + scaled("Modified_Shannon_index"),
)
def _(v):
    return d.shannon_index(v("obs_groups"), config.SITE_KEYS + [_TAX])


@query(
    "scale_by_study_max",
    f"SELECT SS, SSBS, {scale_sql(['m'], 'SS')} FROM (SELECT SS, SSBS, max(Measurement) AS m FROM {{site_obs}} GROUP BY SS, SSBS) t",
    "m Study_max_m Scaled_m",
)
def _(v):
    sites = v("site_obs").groupBy("SS", "SSBS").agg(F.max("Measurement").alias("m"))
    return d.scale_by_study_max(sites, ["m"], [])


_DENSITY = ["Road_density_1km", "Road_density_50km"]


@query(
    "study_means",
    "SELECT SSBS, SS, "
    + ", ".join(_DENSITY)
    + ", "
    + ", ".join(f"avg({c}) OVER (PARTITION BY SS) AS Mean_{c.lower()}" for c in _DENSITY)
    + " FROM {site_features}",
    _DENSITY + [f"Mean_{c.lower()}" for c in _DENSITY],
)
def _(v):
    df = site_features(v).select("SSBS", "SS", *_DENSITY)
    return d.study_means(df, [*_DENSITY, "Elevation_1km"])


_IMPUTED = ["Road_density_1km", "Min_temp_coldest_month_1km_log", "Elevation_1km"]
PARTS["with_gaps"] = (
    "SELECT SS, SSB, SSBS, Road_density_1km, CASE WHEN Min_temp_coldest_month_1km + 1 > 0 THEN ln(Min_temp_coldest_month_1km + 1) END "
    "AS Min_temp_coldest_month_1km_log, CASE WHEN SS IN ('S3', 'S4') OR SSB LIKE '%B2' THEN NULL ELSE Elevation_1km END AS Elevation_1km FROM {site_features}"
)


def impute_sql(columns: list[str], source: str) -> str:
    block = f"SELECT SS, SSB, SSBS, {', '.join(f'coalesce({c}, avg({c}) OVER (PARTITION BY SSB)) AS {c}' for c in columns)} FROM {{{source}}}"
    study = f"SELECT SS, SSB, SSBS, {', '.join(f'coalesce({c}, avg({c}) OVER (PARTITION BY SS)) AS {c}' for c in columns)} FROM ({block}) b"
    return f"SELECT SS, SSB, SSBS, {', '.join(f'coalesce({c}, avg({c}) OVER ()) AS {c}' for c in columns)} FROM ({study}) s"


@query("impute_hierarchical", impute_sql(_IMPUTED, "with_gaps"), _IMPUTED)
def _(v):
    from ecoframe.operators.transforms import nonlinear_transforms

    df, _ = nonlinear_transforms(site_features(v), ["Min_temp_coldest_month_1km"], [])
    gap = F.col("SS").isin("S3", "S4") | F.col("SSB").like("%B2")
    df = df.select(
        "SS", "SSB", "SSBS", "Road_density_1km", "Min_temp_coldest_month_1km_log",
        F.when(~gap, F.col("Elevation_1km")).alias("Elevation_1km"),
    )
    return d.impute_hierarchical(df, [*_IMPUTED, "not_there"])


_ATTRIBUTES = ["Biome", "Predominant_land_use", "Use_intensity"]
_ALPHA = {
    "Total_abundance": (f"coalesce(sum({_Y}), 0)", f"WHERE {_AB}"),
    "Mean_abundance": (f"avg({_Y})", f"WHERE {_AB}"),
    "Geometric_mean_abundance": (f"exp(avg(ln({_Y} + 1))) - 1", ""),
    "Species_richness": (f"CAST(sum(CASE WHEN {_Y} > 0 THEN 1 ELSE 0 END) AS BIGINT)", f"WHERE {_AB}"),
}
for _m, (_value, _where) in _ALPHA.items():
    PARTS[f"alpha_{_m}"] = metric_sql(f"{_KEYS}, {_TAX}", _TAX, _m, _value, _where)
PARTS["alpha_Shannon"] = f"SELECT SS, SSB, SSBS, {_TAX}, {scale_sql(['Shannon_index', 'Modified_Shannon_index'], 'SS, ' + _TAX)} FROM {{shannon}}"

_ALPHA_COLUMNS = [c for m in d.ALPHA_METRICS for c in scaled(m)]
PARTS["alpha"] = (
    f"SELECT t.SS, t.SSB, t.SSBS, t.{_TAX}, {', '.join(_ALPHA_COLUMNS)}, {', '.join(_ATTRIBUTES)} FROM {{alpha_Total_abundance}} t "
    + " ".join(
        f"LEFT JOIN {{alpha_{m}}} j{i} USING (SS, SSB, SSBS, {_TAX})"
        for i, m in enumerate(["Mean_abundance", "Geometric_mean_abundance", "Species_richness", "Shannon"])
    )
    + f" LEFT JOIN (SELECT SSBS, {', '.join(_ATTRIBUTES)} FROM {{site_base}}) a USING (SSBS)"
)
ALPHA_DOUBLES = [c for c in _ALPHA_COLUMNS if c not in ("Species_richness", "Study_max_Species_richness")]


def alpha_input(v):
    return v("obs_groups").select(
        *config.SITE_KEYS, *_ATTRIBUTES, "Diversity_metric_type", "Taxon_name_entered", "Measurement", _Y, _TAX, "Kingdom"
    )


def alpha(v, level: int = 1, obs=None):
    obs = alpha_input(v) if obs is None else obs
    return d.alpha_diversity(obs, level, ["Taxon_name_entered"], [_TAX, "Kingdom"])


@query("alpha_diversity", "SELECT * FROM {alpha}", ALPHA_DOUBLES)
def _(v):
    return alpha(v).drop("Diversity_metric_type")


_PATH = ["Kingdom", "Phylum", "Class"]


def level_sql(level: int) -> str:
    """All alpha metrics of one level, from the observations."""
    tax = _PATH[:level]
    listed, complete = "".join(f", {t}" for t in tax), " AND ".join(["true", *[f"b.{t} IS NOT NULL" for t in tax]])
    y, ab = "Effort_corrected_measurement", "Diversity_metric_type = 'Abundance'"
    base = f"""SELECT SS, SSB, SSBS{listed}, coalesce(sum({y}) FILTER ({ab}), 0) AS Total_abundance, avg({y}) FILTER ({ab}) AS Mean_abundance,
        exp(avg(ln(1 + {y}))) - 1 AS Geometric_mean_abundance, count(*) FILTER ({ab} AND {y} > 0) AS Species_richness,
        coalesce(sum({y}) FILTER ({y} > 0), 0) AS pos, coalesce(sum({y} * ln({y})) FILTER ({y} > 0), 0) AS ylny, count(*) FILTER ({ab}) AS nab
      FROM {{site_obs}} GROUP BY SS, SSB, SSBS{listed}"""
    shannon = f"SELECT *, CASE WHEN Species_richness = 1 OR Total_abundance = 0 THEN 0 WHEN Total_abundance > 0 THEN (ln(Total_abundance) * pos - ylny) / Total_abundance END AS Shannon_index FROM ({base}) s0"
    both = f"SELECT *, ln(Total_abundance + 1) * Shannon_index AS Modified_Shannon_index FROM ({shannon}) s1"
    maxima = ", ".join(f"max({m}){'' if m == 'Geometric_mean_abundance' else ' FILTER (nab > 0)'} AS Study_max_{m}" for m in d.ALPHA_METRICS)
    using = " AND ".join(["b.SS = m.SS", *[f"b.{t} = m.{t}" for t in tax]])
    columns = []
    for m in d.ALPHA_METRICS:
        three = [f"b.{m}", f"m.Study_max_{m}", f"CASE WHEN m.Study_max_{m} = 0 THEN 0e0 ELSE b.{m} / m.Study_max_{m} END"]
        names = [m, f"Study_max_{m}", f"Scaled_{m}"]
        columns += [f"{e if m == 'Total_abundance' else f'CASE WHEN {complete} THEN {e} END'} AS {n}" for e, n in zip(three, names)]
    path = ", ".join(f"b.{t}" if t in tax else f"CAST(NULL AS VARCHAR) AS {t}" for t in _PATH)
    return (
        f"SELECT {level} AS level, b.SS, b.SSB, b.SSBS, {path}, {', '.join(columns)} FROM ({both}) b "
        f"LEFT JOIN (SELECT SS{listed}, {maxima} FROM ({both}) x GROUP BY SS{listed}) m ON {using} WHERE b.nab > 0"
    )


for _level in range(4):
    PARTS[f"alpha_level_{_level}"] = level_sql(_level)


@query(
    "alpha_diversity_levels",
    f"SELECT l.*, a.Biome, a.Longitude FROM ({' UNION ALL '.join(f'SELECT * FROM {{alpha_level_{n}}}' for n in range(4))}) l LEFT JOIN {{site_base}} a USING (SSBS)",
    [*ALPHA_DOUBLES, "Longitude"],
)
def _(v):
    obs = v("site_obs").select(*config.SITE_KEYS, "Biome", "Longitude", "Diversity_metric_type", "Taxon_name_entered", "Measurement", _Y, *_PATH)
    # Sums and attributes both read the observations; written, their joins run once and end a stage.
    obs = materialise(obs, "observations")
    return d.alpha_diversity_levels(obs, [0, 1, 2, 3], ["Taxon_name_entered"], _PATH).drop("Diversity_metric_type")


@query("site_attributes", "SELECT SSBS, SS, Biome, Max_linear_extent_metres FROM {site_base} WHERE SSBS IN (SELECT SSBS FROM {site_obs})", "Max_linear_extent_metres")
def _(v):
    return d.site_attributes(
        v("site_obs").select("SSBS", "SS", "Biome", "Max_linear_extent_metres", "Taxon_name_entered"), ["Taxon_name_entered"]
    ).drop("Taxon_name_entered")


@query(
    "quantile_nearest",
    """SELECT SS, max(CASE WHEN rn - 1 = round((n - 1) * 0.25e0) THEN Measurement END) AS q1,
         max(CASE WHEN rn - 1 = round((n - 1) * 0.75e0) THEN Measurement END) AS q3
       FROM (SELECT SS, Measurement, row_number() OVER (PARTITION BY SS ORDER BY Measurement) AS rn, count(*) OVER (PARTITION BY SS) AS n
             FROM {site_obs} WHERE Measurement IS NOT NULL) t GROUP BY SS""",
    "q1 q3",
)
def _(v):
    from ecoframe.operators.ranking import quantiles

    return quantiles(v("site_obs").select("SS", "Measurement"), ["SS"], "Measurement", {"q1": 0.25, "q3": 0.75})


@query("median_extent", "SELECT median(Max_linear_extent_metres) AS median_extent FROM {site_base}", "median_extent")
def _(v):
    return d.median_extent(v("site_base"))


# --- beta diversity -------------------------------------------------------------------------

PARTS["overlap"] = """
    SELECT a.SS, a.SSBS AS Primary_minimal_site, b.SSBS AS Other_site, sum(least(a.Measurement, b.Measurement)) AS ov
    FROM {site_obs} a JOIN {site_obs} b ON a.SS = b.SS AND a.Taxon_name_entered = b.Taxon_name_entered AND a.SSBS <> b.SSBS
    GROUP BY a.SS, a.SSBS, b.SSBS"""
PARTS["bray"] = """
    SELECT p.SS, p.Primary_minimal_site, p.Other_site, CASE WHEN t1.s = 0 AND t2.s = 0 THEN NULL WHEN t1.s = 0 OR t2.s = 0 THEN 0
        ELSE 2 * coalesce(o.ov, 0) / (t1.s + t2.s) END AS Bray_Curtis_score
    FROM {pairs} p JOIN {site_totals} t1 ON p.Primary_minimal_site = t1.SSBS JOIN {site_totals} t2 ON p.Other_site = t2.SSBS
    LEFT JOIN {overlap} o ON p.Primary_minimal_site = o.Primary_minimal_site AND p.Other_site = o.Other_site"""
PARTS["site_totals"] = "SELECT SSBS, sum(Measurement) AS s FROM {site_obs} GROUP BY SSBS"


@query("bray_curtis", "SELECT * FROM {bray}", "Bray_Curtis_score")
def _(v):
    obs = v("site_obs")
    return d.reference_bray_curtis(obs, obs, [])


PARTS["unit_totals"] = f"SELECT SSBS, {_TAX}, sum(Measurement) AS s FROM {{obs_groups}} GROUP BY SSBS, {_TAX}"
PARTS["unit_overlap"] = f"""
    SELECT a.SSBS AS Primary_minimal_site, b.SSBS AS Other_site, a.{_TAX}, sum(least(a.Measurement, b.Measurement)) AS ov
    FROM {{obs_groups}} a JOIN {{obs_groups}} b ON a.SS = b.SS AND a.{_TAX} = b.{_TAX} AND a.Taxon_name_entered = b.Taxon_name_entered AND a.SSBS <> b.SSBS
    GROUP BY a.SSBS, b.SSBS, a.{_TAX}"""


@query(
    "bray_curtis_by_taxon",
    f"""SELECT p.SS, p.Primary_minimal_site, p.Other_site, t1.{_TAX}, CASE WHEN t1.s = 0 AND t2.s = 0 THEN NULL WHEN t1.s = 0 OR t2.s = 0 THEN 0
        ELSE 2 * coalesce(o.ov, 0) / (t1.s + t2.s) END AS Bray_Curtis_score
      FROM {{pairs}} p JOIN {{unit_totals}} t1 ON p.Primary_minimal_site = t1.SSBS
      JOIN {{unit_totals}} t2 ON p.Other_site = t2.SSBS AND t1.{_TAX} = t2.{_TAX}
      LEFT JOIN {{unit_overlap}} o ON p.Primary_minimal_site = o.Primary_minimal_site AND p.Other_site = o.Other_site AND o.{_TAX} = t1.{_TAX}""",
    "Bray_Curtis_score",
)
def _(v):
    return d.reference_bray_curtis(v("site_obs"), v("obs_groups"), [_TAX])


_PATH = ["Kingdom", "Phylum", "Class"]
_KNOWN = " AND ".join(f"{t} IS NOT NULL" for t in _PATH)
_SAME = " AND ".join(f"a.{t} = b.{t}" for t in _PATH)
_PATH_SQL = ", ".join(_PATH)
PARTS["path_totals"] = f"SELECT SSBS, {_PATH_SQL}, sum(Measurement) AS s FROM {{site_obs}} WHERE {_KNOWN} GROUP BY SSBS, {_PATH_SQL}"
PARTS["path_overlap"] = f"""
    SELECT a.SSBS AS Primary_minimal_site, b.SSBS AS Other_site, {', '.join(f'a.{t}' for t in _PATH)}, sum(least(a.Measurement, b.Measurement)) AS ov
    FROM {{site_obs}} a JOIN {{site_obs}} b ON a.SS = b.SS AND {_SAME} AND a.Taxon_name_entered = b.Taxon_name_entered AND a.SSBS <> b.SSBS
    GROUP BY ALL"""


@query(
    "bray_curtis_level_3",
    f"""SELECT p.SS, p.Primary_minimal_site, p.Other_site, {', '.join(f'a.{t}' for t in _PATH)},
        CASE WHEN a.s = 0 AND b.s = 0 THEN NULL WHEN a.s = 0 OR b.s = 0 THEN 0 ELSE 2 * coalesce(o.ov, 0) / (a.s + b.s) END AS Bray_Curtis_score
      FROM {{pairs}} p JOIN {{path_totals}} a ON p.Primary_minimal_site = a.SSBS
      JOIN {{path_totals}} b ON p.Other_site = b.SSBS AND {_SAME}
      LEFT JOIN {{path_overlap}} o ON p.Primary_minimal_site = o.Primary_minimal_site AND p.Other_site = o.Other_site
        AND {' AND '.join(f'o.{t} = a.{t}' for t in _PATH)}""",
    "Bray_Curtis_score",
)
def _(v):
    obs = v("site_obs")
    return d.reference_bray_curtis(obs, obs, _PATH)


_A = "pow(sin((radians(r.Latitude) - radians(o.Latitude)) / 2), 2) + cos(radians(o.Latitude)) * cos(radians(r.Latitude)) * pow(sin((radians(r.Longitude) - radians(o.Longitude)) / 2), 2)"
PARTS["distances"] = f"""
    SELECT p.SS, p.Primary_minimal_site, p.Other_site,
      6371000e0 * 2 * asin(sqrt(least({_A}, 1e0))) / (SELECT median(Max_linear_extent_metres) FROM {{site_base}} WHERE SSBS IN (SELECT SSBS FROM {{site_obs}})) AS x
    FROM {{pairs}} p JOIN {{site_base}} o ON p.Other_site = o.SSBS JOIN {{site_base}} r ON p.Primary_minimal_site = r.SSBS"""


def distance_sql(name: str) -> str:
    return f"x AS {name}, ln(x + 1) AS {name}_log, sqrt(x + 1) AS {name}_sqrt, pow(x, 1e0/3) AS {name}_cbrt"


def distance_columns(name: str) -> list[str]:
    return [name] + [f"{name}_{k}" for k in ("log", "sqrt", "cbrt")]


def _pairs_with(v, columns):
    sites = v("site_base").select("SSBS", "Latitude", "Longitude").join(v("site_cov").select("SSBS", *columns), "SSBS")
    return ["SS", "Primary_minimal_site", "Other_site"], j.reference_pair_features(v("site_obs"), sites, columns)


@query("haversine", f"SELECT SS, Primary_minimal_site, Other_site, {distance_sql('Haversine_distance')} FROM {{distances}}", distance_columns("Haversine_distance"), digits=3)
def _(v):
    keys, df = _pairs_with(v, ["Elevation_1km"])
    extent = d.median_extent(d.site_attributes(v("site_obs").select("SSBS", "Max_linear_extent_metres"), ["Max_linear_extent_metres"])).scalar()
    return d.haversine(df, extent).select(*keys, *distance_columns("Haversine_distance"))


_ENV = config.ENVIRONMENT_DISTANCE_VARS
PARTS["gower_pairs"] = (
    "SELECT p.SS, p.Primary_minimal_site, p.Other_site, ("
    + " + ".join(f"CASE WHEN o.{c} IS NULL OR r.{c} IS NULL THEN NULL WHEN o.{c} = r.{c} OR greatest(o.{c}, r.{c}) = 0 THEN 0 ELSE 1 END" for c in _ENV)
    + f") / {len(_ENV)} AS x FROM {{pairs}} p LEFT JOIN {{site_cov}} o ON p.Other_site = o.SSBS JOIN {{site_cov}} r ON p.Primary_minimal_site = r.SSBS"
)


@query("gower_pair", f"SELECT SS, Primary_minimal_site, Other_site, {distance_sql('Gower_distance')} FROM {{gower_pairs}}", distance_columns("Gower_distance"))
def _(v):
    keys, df = _pairs_with(v, _ENV)
    return d.gower_pair(df, _ENV).select(*keys, *distance_columns("Gower_distance"))


@query(
    "gower_pair_global",
    "SELECT p.SS, p.Primary_minimal_site, p.Other_site, ("
    + " + ".join(f"abs(o.{c} - r.{c}) / (SELECT max({c}) - min({c}) FROM {{site_cov}})" for c in _ENV)
    + f") / {len(_ENV)} AS Gower_distance FROM {{pairs}} p LEFT JOIN {{site_cov}} o ON p.Other_site = o.SSBS JOIN {{site_cov}} r ON p.Primary_minimal_site = r.SSBS",
    "Gower_distance",
)
def _(v):
    keys, df = _pairs_with(v, _ENV)
    ranges = v("site_cov").agg(F.struct(*[(F.max(c) - F.min(c)).alias(c) for c in _ENV])).scalar()
    return d.gower_pair(df, _ENV, "global", ranges).select(*keys, "Gower_distance")


_DIFF = ["Road_density_1km", "Annual_mean_temp_1km", "Elevation_1km"]
PARTS["beta"] = f"""
    SELECT b.SS, b.Primary_minimal_site, b.Other_site AS SSBS, b.Bray_Curtis_score, s.SSB, s.Biome, s.Predominant_land_use,
      {', '.join(f'o.{c}, o.{c} - r.{c} AS {c}_diff' for c in _DIFF)},
      x1.x AS Haversine_distance, ln(x1.x + 1) AS Haversine_distance_log, g.x AS Gower_distance, pow(g.x, 1e0/3) AS Gower_distance_cbrt
    FROM {{bray}} b JOIN {{eligible}} e ON b.SS = e.SS
    JOIN {{site_base}} s ON b.Other_site = s.SSBS
    JOIN {{site_cov}} o ON b.Other_site = o.SSBS JOIN {{site_cov}} r ON b.Primary_minimal_site = r.SSBS
    JOIN {{distances}} x1 ON b.Primary_minimal_site = x1.Primary_minimal_site AND b.Other_site = x1.Other_site
    JOIN {{gower_pairs}} g ON b.Primary_minimal_site = g.Primary_minimal_site AND b.Other_site = g.Other_site"""
BETA_DOUBLES = (
    ["Bray_Curtis_score"] + [c for n in _DIFF for c in (n, f"{n}_diff")]
    + ["Haversine_distance", "Haversine_distance_log", "Gower_distance", "Gower_distance_cbrt"]
)


def beta(v):
    obs = v("site_obs").select(
        *config.SITE_KEYS, "Biome", "Taxon_name_entered", "Measurement", "Sampling_effort",
        "Predominant_land_use", "Use_intensity", "Max_linear_extent_metres", "Longitude", "Latitude",
    )
    df = obs.join(v("site_cov").select("SSBS", *dict.fromkeys(_DIFF + _ENV)), "SSBS")
    out = d.beta_diversity(df, 0, ["Taxon_name_entered"], list(dict.fromkeys(_DIFF + _ENV)), _ENV)
    return out.select("SS", "Primary_minimal_site", "SSBS", "SSB", "Biome", "Predominant_land_use", *BETA_DOUBLES)


@query("beta_diversity", "SELECT * FROM {beta}", BETA_DOUBLES, digits=3)
def _(v):
    return beta(v)


_FEATURE = ["Road_density_1km", "Annual_mean_temp_1km", "Elevation_1km"]
_NEW = ["Road_density_1km_log", "Annual_mean_temp_1km_sqrt", "Elevation_1km_square"]
PARTS["feature_gaps"] = f"""
    SELECT SS, SSB, SSBS, Road_density_1km, Annual_mean_temp_1km, Elevation_1km, {transform_sql('Road_density_1km')},
      {transform_sql('Annual_mean_temp_1km')}, {transform_sql('Elevation_1km', True)}
    FROM (SELECT o.SS, o.SSB, o.SSBS, Road_density_1km, Annual_mean_temp_1km / 10 AS Annual_mean_temp_1km, Elevation_1km
          FROM {{site_obs}} o JOIN {{site_cov}} c ON o.SSBS = c.SSBS) t"""


@query(
    "feature_table",
    "SELECT s.SSBS, s.n, "
    + ", ".join(f"i.{c}" for c in _FEATURE + _NEW)
    + ", m.mean_road_density_1km AS Mean_road_density_1km FROM (SELECT SSBS, SS, count(*) AS n FROM {obs_groups} GROUP BY SSBS, SS) s "
    + f"JOIN (SELECT DISTINCT * EXCLUDE (SS, SSB) FROM ({impute_sql(_FEATURE + _NEW, 'feature_gaps')}) x) i ON s.SSBS = i.SSBS "
    + "JOIN (SELECT SS, avg(Road_density_1km) AS mean_road_density_1km FROM {feature_gaps} GROUP BY SS) m ON s.SS = m.SS",
    _FEATURE + _NEW + ["Mean_road_density_1km"],
    digits=5,
)
def _(v):
    from ecoframe.plans.features import feature_table

    obs = v("site_obs").join(v("site_cov").select("SSBS", *_FEATURE), "SSBS")
    out = feature_table(obs, ["Road_density_1km"], ["Annual_mean_temp_1km"], ["Elevation_1km"])
    # Site-level values, as the rows of a site share them.
    return out.groupBy("SSBS").agg(
        F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in _FEATURE + _NEW + ["Mean_road_density_1km"]]
    )
