"""From combined source data to the feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ecoframe import config
from ecoframe.operators import diversity, transforms
from ecoframe.operators.skew import attach


def feature_table(
    df: DataFrame,
    density: list[str] | None = None,
    bioclimatic: list[str] | None = None,
    topographic: list[str] | None = None,
) -> DataFrame:
    """Land-use dummies, rescaling, transforms, study means, imputation and species groups.

    Study means are taken before imputation, as they describe the measured sites only, and joined
    after it, so that neither aggregate has a join below it.
    """
    density = config.DENSITY_VARS if density is None else density
    bioclimatic = config.BIOCLIMATIC_VARS if bioclimatic is None else bioclimatic
    topographic = config.TOPOGRAPHIC_VARS if topographic is None else topographic
    out = transforms.one_hot(df, "Predominant_land_use", config.LAND_USES)
    out = transforms.land_use_intensity(out)
    out = transforms.group_secondary_vegetation(out)
    out = transforms.land_use_rollup_flags(out)
    out = transforms.rescale_climate(out, bioclimatic)
    out, new = transforms.nonlinear_transforms(
        out, density + bioclimatic + topographic, bioclimatic + topographic
    )
    means = diversity.study_mean_table(out, density + new)
    out = diversity.impute_hierarchical(out, density + bioclimatic + topographic + new)
    return transforms.custom_taxon_group(attach(out, means, ["SS"], null_safe=False))
