from __future__ import annotations

from pyspark.sql import functions as F

from ecoframe import config
from ecoframe.operators import transforms as t
from registry.base import PARTS, query

_KEYS = "SS, SSB, SSBS, Predominant_land_use, Use_intensity"

PARTS["site_features"] = (
    "SELECT b.SS, b.SSB, b.SSBS, b.Predominant_land_use, b.Use_intensity, b.Biome, b.Realm, b.c_custkey, "
    "b.Longitude, b.Latitude, b.Max_linear_extent_metres, "
    + ", ".join(f"c.{n}" for n in config.CONTINUOUS_VARS if not n.startswith("Pop"))
    + " FROM {site_base} b JOIN {site_cov} c ON b.SSBS = c.SSBS"
)
LUI = "Predominant_land_use || '_' || Use_intensity"


def site_features(v):
    covariates = [n for n in config.CONTINUOUS_VARS if not n.startswith("Pop")]
    base = v("site_base").select(
        "SS", "SSB", "SSBS", "Predominant_land_use", "Use_intensity", "Biome", "Realm", "c_custkey",
        "Longitude", "Latitude", "Max_linear_extent_metres",
    )
    return base.join(v("site_cov"), "SSBS").select(*base.columns, *covariates)


def flag(condition: str, name: str) -> str:
    return f'CASE WHEN {condition} THEN 1 ELSE 0 END AS "{name}"'


_COMMON = ["SS", "SSB", "SSBS", "Taxon_name_entered", "Measurement", "Longitude", "Latitude"]


@query("align_and_order", f"SELECT {', '.join(_COMMON)} FROM {{inventory_a}}", "Longitude Latitude")
def _(v):
    a, b = v("inventory_a"), v("inventory_b")
    keep = [*_COMMON, "only_in_a"]
    return t.align_and_order(a.select(*keep), b.select(*_COMMON, "only_in_b"), _COMMON)[0]


@query("sample_year", "SELECT SSBS, Sample_midpoint, CAST(year(CAST(Sample_midpoint AS DATE)) AS INT) AS Sample_year FROM {site_base}")
def _(v):
    return t.sample_year(v("site_base").select("SSBS", "Sample_midpoint"))


@query("one_hot", f"SELECT {_KEYS}, " + ", ".join(flag(f"Predominant_land_use = '{c}'", c) for c in config.LAND_USES) + " FROM {site_base}")
def _(v):
    return t.one_hot(v("site_base").select(*_KEYS.split(", ")), "Predominant_land_use", config.LAND_USES)


@query(
    "land_use_intensity",
    f"SELECT {_KEYS}, {LUI} AS LU_type_intensity, "
    + ", ".join(flag(f"{LUI} = '{c}'", c) for c in config.LAND_USE_INTENSITIES)
    + " FROM {site_base}",
)
def _(v):
    return t.land_use_intensity(v("site_base").select(*_KEYS.split(", ")))


PARTS["secondary"] = f"""
    SELECT {_KEYS}, {LUI} AS LU_type_intensity, CASE
        WHEN Predominant_land_use ILIKE '%secondary%' THEN 'Secondary vegetation_' || Use_intensity
        WHEN Predominant_land_use ILIKE '%plantation%' AND Use_intensity ILIKE '%minimal%' THEN 'Secondary vegetation_Light use'
        WHEN Predominant_land_use ILIKE '%plantation%' THEN 'Secondary vegetation_Intense use'
        ELSE {LUI} END AS Secondary_veg_intensity
    FROM {{site_base}}"""


@query(
    "group_secondary_vegetation",
    "SELECT s.*, " + ", ".join(flag(f"Secondary_veg_intensity = '{c}'", c) for c in config.SECONDARY_INTENSITIES) + " FROM {secondary} s",
)
def _(v):
    df = t.land_use_intensity(v("site_base").select(*_KEYS.split(", ")))
    keep = [*_KEYS.split(", "), "LU_type_intensity", "Secondary_veg_intensity", *config.SECONDARY_INTENSITIES]
    return t.group_secondary_vegetation(df).select(*[F.col(f"`{c}`") for c in keep])


_USED = "Use_intensity IN ('Light use', 'Intense use')"


@query(
    "land_use_rollup_flags",
    f"SELECT {_KEYS}, "
    + ", ".join(
        [flag("Predominant_land_use ILIKE '%secondary%' OR Predominant_land_use ILIKE '%plantation%'", "Secondary vegetation_All uses")]
        + [flag(f"Predominant_land_use = '{n}'", f"{n}_All uses") for n in ("Urban", "Cropland", "Pasture")]
        + [flag(f"Predominant_land_use = '{n}' AND {_USED}", f"{n}_Light_Intense") for n in ("Cropland", "Pasture", "Primary vegetation")]
        + [flag(f"Predominant_land_use ILIKE '%secondary%' AND {_USED}", "Secondary vegetation_Light_Intense")]
    )
    + " FROM {site_base}",
)
def _(v):
    return t.land_use_rollup_flags(v("site_base").select(*_KEYS.split(", ")))


_SCALED = [c for c in config.BIOCLIMATIC_VARS if "temp" in c.lower() or "precip" in c.lower()]


@query(
    "rescale_climate",
    "SELECT SSBS, Elevation_1km, " + ", ".join(f"{c} / 10 AS {c}" for c in _SCALED) + " FROM {site_features}",
    ["Elevation_1km", *_SCALED],
)
def _(v):
    df = site_features(v).select("SSBS", "Elevation_1km", *_SCALED)
    return t.rescale_climate(df, config.BIOCLIMATIC_VARS)


def transform_sql(name: str, square: bool = False) -> str:
    out = [
        f"CASE WHEN {name} + 1 > 0 THEN ln({name} + 1) END AS {name}_log",
        f"CASE WHEN {name} >= 0 THEN sqrt({name}) END AS {name}_sqrt",
        f"CASE WHEN {name} >= 0 THEN pow({name}, 1e0/3) END AS {name}_cbrt",
    ]
    return ", ".join(out + ([f"{name} * {name} AS {name}_square"] if square else []))


_TRANSFORMED = ["Road_density_1km", "Min_temp_coldest_month_1km", "Elevation_10km"]


@query(
    "nonlinear_transforms",
    f"SELECT SSBS, {', '.join(_TRANSFORMED)}, "
    + ", ".join([transform_sql(_TRANSFORMED[0])] + [transform_sql(n, True) for n in _TRANSFORMED[1:]])
    + " FROM {site_features}",
    _TRANSFORMED + t.nonlinear_names(_TRANSFORMED, _TRANSFORMED[1:]),
)
def _(v):
    df, new = t.nonlinear_transforms(site_features(v).select("SSBS", *_TRANSFORMED), _TRANSFORMED, _TRANSFORMED[1:])
    # A root of a negative number is NaN here and null in the oracle; both count as invalid.
    nan_free = [F.when(~F.isnan(F.col(c)), F.col(c)).alias(c) for c in new]
    return df.select("SSBS", *_TRANSFORMED, *nan_free)


@query(
    "custom_taxon_group",
    "SELECT SSBS, Taxon_name_entered, Kingdom, Phylum, Class, Custom_taxonomic_group FROM {obs_groups}",
)
def _(v):
    df = v("site_obs").select("SSBS", "Taxon_name_entered", "Kingdom", "Phylum", "Class")
    return t.custom_taxon_group(df)


_VALID = ["Road_density_1km", "Annual_mean_temp_1km_log", "Elevation_1km"]
PARTS["partly_invalid"] = (
    "SELECT SSBS, Road_density_1km, Elevation_1km, "
    "CASE WHEN Annual_mean_temp_1km + 1 > 0 THEN ln(Annual_mean_temp_1km + 1) END AS Annual_mean_temp_1km_log "
    "FROM {site_features}"
)


def _partly_invalid(v):
    df, _ = t.nonlinear_transforms(
        site_features(v).select("SSBS", "Road_density_1km", "Elevation_1km", "Annual_mean_temp_1km"),
        ["Annual_mean_temp_1km"], [],
    )
    return df.select("SSBS", "Road_density_1km", "Elevation_1km", "Annual_mean_temp_1km_log")


@query(
    "drop_invalid_rows",
    "SELECT * FROM {partly_invalid} WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _VALID),
    _VALID,
)
def _(v):
    return t.drop_invalid_rows(_partly_invalid(v), _VALID)


@query(
    "invalid_value_report",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_null, 0::BIGINT AS n_nan, 0::BIGINT AS n_inf, "
        f"count(*) FILTER ({c} IS NULL) AS n_invalid FROM {{partly_invalid}}"
        for c in _VALID
    )
    + ") r WHERE n_invalid > 0",
)
def _(v):
    return t.invalid_value_report(_partly_invalid(v), _VALID)


@query(
    "filter_scope",
    "SELECT SSBS, Biome, Realm, Taxon_name_entered FROM {site_obs} WHERE Biome NOT IN ('ASIA', 'EUROPE') AND Realm NOT IN ('R1')",
)
def _(v):
    df = v("site_obs").select("SSBS", "Biome", "Realm", "Taxon_name_entered")
    return t.filter_scope(df, "exclude", {"Biome": ["ASIA", "EUROPE"], "Realm": ["R1"], "Country": []})


@query(
    "filter_taxonomic_scope",
    "SELECT SSBS, Kingdom, Phylum, Class, Taxon_name_entered FROM {site_obs} WHERE Kingdom IN ('Animalia', 'Plantae') AND Phylum IN ('Chordata', 'Tracheophyta')",
)
def _(v):
    df = v("site_obs").select("SSBS", "Kingdom", "Phylum", "Class", "Taxon_name_entered")
    values = {"All_species": [], "Kingdom": ["Animalia", "Plantae"], "Phylum": ["Chordata", "Tracheophyta"], "Class": ["Aves"]}
    return t.filter_taxonomic_scope(df, "Phylum", "include", values)


@query(
    "filter_known_land_use",
    "SELECT SSBS, Predominant_land_use, Use_intensity FROM {site_base} WHERE Predominant_land_use <> 'Cannot decide' AND Use_intensity <> 'Cannot decide'",
)
def _(v):
    return t.filter_known_land_use(v("site_base").select("SSBS", "Predominant_land_use", "Use_intensity"))


_CAT = ["Cropland", "Pasture"]
_CONT = ["Road_density_1km", "Elevation_1km"]


@query(
    "interaction_terms",
    "SELECT SSBS, "
    + ", ".join(_CONT)
    + ", "
    + ", ".join(flag(f"Predominant_land_use = '{c}'", c) for c in _CAT)
    + ", "
    + ", ".join(f"CASE WHEN Predominant_land_use = '{b}' THEN 1 ELSE 0 END * {a} AS \"{b} x {a}\"" for a in _CONT for b in _CAT)
    + " FROM {site_features}",
    _CONT + [f"{b} x {a}" for a in _CONT for b in _CAT],
)
def _(v):
    df = t.one_hot(site_features(v).select("SSBS", "Predominant_land_use", *_CONT), "Predominant_land_use", _CAT)
    return t.interaction_terms(df, _CONT, _CAT)[0].drop("Predominant_land_use")


@query(
    "clip_response",
    "SELECT l_orderkey, l_linenumber, SSBS, greatest(least(Observed, 1 - 1e-6), 1e-6) AS Observed FROM {predictions}",
    "Observed",
)
def _(v):
    return t.clip_response(v("predictions").select("l_orderkey", "l_linenumber", "SSBS", "Observed"), "Observed")


def _expit(x: str) -> str:
    return f"(1 / (1 + exp(-({x}))))"


@query(
    "inverse_link_effects",
    'SELECT chain, draw, level, "group", '
    + _expit("alpha") + " AS alpha, "
    + ", ".join(f"{_expit(f'alpha + b{i}')} - {_expit('alpha')} AS b{i}" for i in range(1, 5))
    + " FROM {draws}",
    "alpha b1 b2 b3 b4",
)
def _(v):
    d = v("draws").withColumn("beta", F.array("b1", "b2", "b3", "b4"))
    out = t.inverse_link_effects(d)
    return out.select("chain", "draw", "level", "group", "alpha", *[F.col("beta")[i - 1].alias(f"b{i}") for i in range(1, 5)])
