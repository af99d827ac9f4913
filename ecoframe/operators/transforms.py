"""Derived columns and row filters. One projection each, no data pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ecoframe import config
from ecoframe.functions.nulls import all_of, clamp, col, is_finite, label, quoted
from ecoframe.functions.stats import inverse_link

_LIGHT_INTENSE = ["Light use", "Intense use"]


def align_and_order(df_a: DataFrame, df_b: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Keep the common columns of both frames, in the configured order."""
    common = [c for c in df_a.columns if c in df_b.columns]
    missing = [c for c in common if c not in order]
    extra = [c for c in order if c not in common]
    if missing:
        raise ValueError(f"Columns absent from the configured order: {missing}")
    if extra:
        raise ValueError(f"Configured columns absent from the inputs: {extra}")
    pick = [col(c) for c in order]
    return df_a.select(*pick), df_b.select(*pick)


def sample_year(df: DataFrame, source: str = "Sample_midpoint", name: str = "Sample_year") -> DataFrame:
    return df.withColumn(name, F.year(F.to_date(col(source), "yyyy-MM-dd")))


def indicator(condition: Column, name: str) -> Column:
    return F.when(condition, 1).otherwise(0).alias(name)


def dummies(column: str, categories: list[str]) -> list[str]:
    """SQL text of the 0/1 columns of ``column``."""
    return [f"CASE WHEN `{column}` = {quoted(v)} THEN 1 ELSE 0 END AS `{v}`" for v in categories]


def one_hot(df: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """0/1 column per listed category; an unlisted or null category gives all zeros."""
    return df.selectExpr("*", *dummies(column, categories))


def land_use_intensity(df: DataFrame) -> DataFrame:
    """Combined land use and intensity label plus its dummies."""
    combined = label(F.col("Predominant_land_use"), F.col("Use_intensity"))
    return one_hot(
        df.withColumn("LU_type_intensity", combined), "LU_type_intensity", config.LAND_USE_INTENSITIES
    )


def group_secondary_vegetation(df: DataFrame) -> DataFrame:
    """Fold all secondary vegetation, and plantations, into one group with intensities."""
    c = F.col("LU_type_intensity")
    secondary = F.when(
        F.lower(c).contains("secondary"),
        F.concat(F.lit("Secondary vegetation_"), F.get(F.split(c, "_"), F.lit(1))),
    ).otherwise(c)
    plantation = F.when(
        F.lower(c).contains("minimal"), F.lit("Secondary vegetation_Light use")
    ).otherwise(F.lit("Secondary vegetation_Intense use"))
    grouped = F.when(F.lower(secondary).contains("plantation"), plantation).otherwise(secondary)
    return one_hot(
        df.withColumn("Secondary_veg_intensity", grouped), "Secondary_veg_intensity", config.SECONDARY_INTENSITIES
    )


def land_use_rollup_flags(df: DataFrame) -> DataFrame:
    """Flags over all intensities, or over light and intense use together."""
    use, used = F.col("Predominant_land_use"), F.col("Use_intensity").isin(_LIGHT_INTENSE)
    secondary = F.lower(use).contains("secondary")
    flags = [indicator(secondary | F.lower(use).contains("plantation"), "Secondary vegetation_All uses")]
    flags += [indicator(use == name, f"{name}_All uses") for name in ("Urban", "Cropland", "Pasture")]
    flags += [
        indicator((use == name) & used, f"{name}_Light_Intense")
        for name in ("Cropland", "Pasture", config.PRIMARY)
    ]
    flags.append(indicator(secondary & used, "Secondary vegetation_Light_Intense"))
    return df.select("*", *flags)


def rescale_climate(df: DataFrame, variables: list[str]) -> DataFrame:
    """Temperatures and precipitation are stored times ten."""
    scaled = {v for v in variables if "temp" in v.lower() or "precip" in v.lower()}
    return df.selectExpr(*[f"`{c}` / 10D AS `{c}`" if c in scaled else f"`{c}`" for c in df.columns])


def nonlinear_names(sublinear: list[str], exponential: list[str]) -> list[str]:
    names = [f"{c}_{kind}" for c in sublinear for kind in ("log", "sqrt", "cbrt")]
    return names + [f"{c}_square" for c in exponential]


def nonlinear_transforms(
    df: DataFrame, sublinear: list[str], exponential: list[str]
) -> tuple[DataFrame, list[str]]:
    """Log, square-root, cube-root and square columns; returns the frame and the new names.

    ``pow(x, 1/3)`` and not ``cbrt``: negative input must be invalid, as with the other roots.
    """
    new: list[str] = []
    for name in sublinear:
        x = f"CAST(`{name}` AS DOUBLE)"
        new += [
            f"ln({x} + 1) AS `{name}_log`",
            f"sqrt({x}) AS `{name}_sqrt`",
            f"pow({x}, 1D / 3D) AS `{name}_cbrt`",
        ]
    for name in exponential:
        x = f"CAST(`{name}` AS DOUBLE)"
        new.append(f"{x} * {x} AS `{name}_square`")
    return df.selectExpr("*", *new), nonlinear_names(sublinear, exponential)


def taxon_group_column() -> Column:
    phylum, cls, kingdom = F.col("Phylum"), F.col("Class"), F.col("Kingdom")
    arthropods = F.when(cls == "Insecta", F.lit("Insecta")).otherwise(F.lit("Other Arthropoda"))
    chordates = (
        F.when(cls.isin("Aves", "Mammalia"), cls)
        .when(cls.isin("Amphibia", "Reptilia"), F.lit("Amphibia_Reptilia"))
        .otherwise(F.lit("Other Chordata"))
    )
    return (
        F.when(phylum == "Arthropoda", arthropods)
        .when(phylum == "Chordata", chordates)
        .when(phylum == "Tracheophyta", F.lit("Tracheophyta"))
        .when(kingdom == "Fungi", F.lit("Fungi"))
        .otherwise(F.concat(F.lit("Other "), kingdom))
    )


def custom_taxon_group(df: DataFrame, name: str = "Custom_taxonomic_group") -> DataFrame:
    """Species group used as a grouping level; rows without one are dropped."""
    return df.withColumn(name, taxon_group_column()).filter(F.col(name).isNotNull())


def drop_invalid_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.filter(all_of([is_finite(col(c)) for c in present]))


def invalid_value_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null, NaN and infinity counts of the columns that have any."""
    present = [c for c in columns if c in df.columns]

    def count_if(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")

    rows = []
    for c in present:
        d = col(c).cast("double")
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                count_if(col(c).isNull()).alias("n_null"),
                count_if(F.isnan(d)).alias("n_nan"),
                count_if(F.abs(d) == F.lit(float("inf"))).alias("n_inf"),
            )
        )
    return (
        df.agg(F.array(*rows).alias("r"))
        .select(F.explode("r").alias("r"))
        .select("r.*")
        .withColumn("n_invalid", F.col("n_null") + F.col("n_nan") + F.col("n_inf"))
        .filter(F.col("n_invalid") > 0)
        .orderBy(F.desc("n_invalid"), "column")
    )


def filter_scope(df: DataFrame, logic: str, values: dict[str, list[str]]) -> DataFrame:
    """Keep (``include``) or remove (``exclude``) listed values, column by column."""
    if logic not in ("include", "exclude"):
        raise ValueError(f"Invalid filtering logic: {logic}")
    conditions = [
        col(c).isin(list(v)) if logic == "include" else ~col(c).isin(list(v))
        for c, v in values.items()
        if v
    ]
    return df.filter(all_of(conditions)) if conditions else df


_TAXON_ORDER = ["All_species", "Custom", "Kingdom", "Phylum", "Class", "Order", "Family"]


def filter_taxonomic_scope(
    df: DataFrame, resolution: str, logic: str, values: dict[str, list[str]]
) -> DataFrame:
    """``filter_scope`` limited to levels at or above the resolution."""
    if resolution == "All_species":
        return df
    allowed = _TAXON_ORDER[: _TAXON_ORDER.index(resolution) + 1]
    usable = {
        ("Custom_taxonomic_group" if level == "Custom" else level): v
        for level, v in values.items()
        if level in allowed and level != "All_species"
    }
    return filter_scope(df, logic, usable)


def filter_known_land_use(df: DataFrame, require_intensity: bool = True) -> DataFrame:
    out = df.filter(F.col("Predominant_land_use") != config.UNKNOWN)
    return out.filter(F.col("Use_intensity") != config.UNKNOWN) if require_intensity else out


def interaction_terms(
    df: DataFrame, continuous: list[str], categorical: list[str]
) -> tuple[DataFrame, list[str]]:
    pairs = [(a, b) for a in continuous for b in categorical]
    names = [f"{b} x {a}" for a, b in pairs]
    new = [(col(a) * col(b)).alias(n) for (a, b), n in zip(pairs, names)]
    return df.select("*", *new), names


def clip_response(df: DataFrame, column: str, eps: float = config.EPSILON) -> DataFrame:
    """Keep a beta-distributed response off the exact ends of [0, 1]."""
    return df.withColumn(column, clamp(col(column), eps, 1 - eps))


def inverse_link_effects(draws: DataFrame) -> DataFrame:
    """Intercepts and slopes of a logit model as levels and changes on the response scale."""
    base = inverse_link(F.col("alpha"), "logit")
    slope = F.transform("beta", lambda b: inverse_link(F.col("alpha") + b, "logit") - base)
    return draws.withColumn("beta", slope).withColumn("alpha", base)
