"""Column families and other fixed values of the data model.

The lists below are fixed values: names and their order must stay as they are for results to be
comparable. Regular families are generated from their rule.
"""

from __future__ import annotations

# --- fixed values -------------------------------------------------------------------------

SITE_KEYS = ["SS", "SSB", "SSBS"]

TAXONOMIC_LEVELS = ["Custom_taxonomic_group", "Kingdom", "Phylum", "Class", "Order"]

LAND_USES = [
    "Primary vegetation",
    "Young secondary vegetation",
    "Intermediate secondary vegetation",
    "Mature secondary vegetation",
    "Secondary vegetation (indeterminate age)",
    "Plantation forest",
    "Pasture",
    "Cropland",
    "Urban",
]

INTENSITIES = ["Minimal use", "Light use", "Intense use"]

CLIMATE_NAMES = [
    "Annual_mean_temp",
    "Temp_seasonality",
    "Max_temp_warmest_month",
    "Min_temp_coldest_month",
    "Annual_precip",
    "Precip_seasonality",
    "Precip_wettest_month",
    "Precip_driest_month",
]

TOPOGRAPHY_NAMES = ["Elevation", "Slope", "Terrain_roughness", "Terrain_ruggedness_index"]

ENVIRONMENT_DISTANCE_VARS = [
    "Max_temp_warmest_month_1km",
    "Min_temp_coldest_month_1km",
    "Precip_wettest_month_1km",
    "Precip_driest_month_1km",
    "Elevation_1km",
]

POPULATION_INTERVALS = [(1984, 2000), (2000, 2005), (2005, 2010), (2010, 2015), (2015, 2020)]

BUFFER_RADII_KM = [1, 5, 10, 50]

COUNTRY_NAME_OVERRIDES = {
    "United States": "United States of America",
    "Czech Republic": "Czechia",
    "Korea, Republic of": "South Korea",
    "United Republic of Tanzania": "Tanzania",
    "Cote d'Ivoire": "Côte d'Ivoire",
    "Sao Tome and Principe": "São Tomé and Príncipe",
    "Viet Nam": "Vietnam",
    "Lao People's Democratic Republic": "Laos",
    "Iran (Islamic Republic of)": "Iran",
    "Syrian Arab Republic": "Syria",
    "Côte d'Ivoire": "Ivory Coast",
    "Serbia": "Republic of Serbia",
    "Comoros": "Union of the Comoros",
}

COUNTRY_ISO_OVERRIDES = {
    "France": "FRA",
    "Norway": "NOR",
    "Hong Kong": "CHN",
    "French Guiana": "FRA",
    "Puerto Rico": "USA",
    "São Tomé and Príncipe": "STP",
    "Tanzania": "TZA",
    "Côte d'Ivoire": "CIV",
    "Union of the Comoros": "COM",
}

PRIMARY = "Primary vegetation"
MINIMAL = "Minimal use"
UNKNOWN = "Cannot decide"
EPSILON = 1e-6
EARTH_RADIUS_M = 6_371_000.0
KM_PER_DEGREE = 111.32

# --- families generated from a rule -------------------------------------------------------

LAND_USE_INTENSITIES = [f"{use}_{level}" for use in LAND_USES for level in INTENSITIES]
SECONDARY_INTENSITIES = [f"Secondary vegetation_{level}" for level in INTENSITIES]
DENSITY_VARS = [f"{kind}_density_{km}km" for kind in ("Pop", "Road") for km in (1, 10, 50)]
BIOCLIMATIC_VARS = [f"{name}_{km}km" for km in (1, 10) for name in CLIMATE_NAMES]
TOPOGRAPHIC_VARS = [f"{name}_{km}km" for km in (1, 10) for name in TOPOGRAPHY_NAMES]
CONTINUOUS_VARS = DENSITY_VARS + BIOCLIMATIC_VARS + TOPOGRAPHIC_VARS


def columns_with_prefix(columns: list[str], bases: list[str]) -> list[str]:
    """Columns that are one of ``bases`` or a transformation of one (``base_...``)."""
    return [c for c in columns if any(c == b or c.startswith(f"{b}_") for b in bases)]


def prediction_column(mode: str, family: str) -> str:
    """Which prediction column a run is judged on."""
    if family == "bayesian":
        return "Predicted"
    return "Predicted_RE" if "training" in mode.lower() else "Predicted_FE"
