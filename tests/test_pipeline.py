"""The whole way from inventories and covariates to folds, with the full list of variables."""

from pyspark.sql import functions as F

import fixtures
from ecoframe import config
from ecoframe.operators import checks, diversity, folds, joins, scope
from ecoframe.plans import features, model_data
from ecoframe.session import materialise
from tests.conftest import SF


def test_inventory_to_folds(spark):
    cov = fixtures.view(spark, SF, "site_cov")
    roads = [c for c in config.DENSITY_VARS if c.startswith("Road")]
    by_km = lambda names: [cov.select("SSBS", *[n for n in names if n.endswith(f"_{km}km")]) for km in (1, 10)]
    combined = joins.combine_sources(
        fixtures.view(spark, SF, "site_obs"),
        cov.select("SSBS", *roads),
        by_km(config.BIOCLIMATIC_VARS),
        by_km(config.TOPOGRAPHIC_VARS),
        [
            diversity.interpolate_population(fixtures.view(spark, SF, "site_pop"), f"pop_{km}km_", name=f"Pop_density_{km}km")
            for km in (1, 10, 50)
        ],
    )
    table = materialise(features.feature_table(materialise(combined)))
    assert table.count() == fixtures.view(spark, SF, "obs_groups").count()
    used = config.CONTINUOUS_VARS + ["Pop_density_1km_log", "Min_temp_coldest_month_1km_log", "Elevation_1km_square"]
    left = table.agg(*[F.sum(F.when(F.col(c).isNull() | F.isnan(c), 1).otherwise(0)).alias(c) for c in used]).first()
    assert set(left) == {0}
    assert "Mean_pop_density_1km_log" in table.columns and "Secondary vegetation_All uses" in table.columns

    alpha = materialise(diversity.alpha_diversity(table, 1, ["Taxon_name_entered"]))
    assert "Kingdom" not in alpha.columns and "Custom_taxonomic_group" in alpha.columns
    assert all(r.violations == 0 for r in checks.check_alpha(alpha, "Shannon_index").collect())

    continuous = config.columns_with_prefix(table.columns, config.CONTINUOUS_VARS)
    beta = materialise(
        diversity.beta_diversity(table, 1, ["Taxon_name_entered"], continuous, config.ENVIRONMENT_DISTANCE_VARS)
    )
    assert beta.count() > 0
    assert not [c for c in beta.columns if c.endswith("_reference")] and "Pop_density_1km_log_diff" in beta.columns
    assert checks.check_beta_scores(beta).first().n_nan == 0
    assert beta.filter((F.col("Bray_Curtis_score") < 0) | (F.col("Bray_Curtis_score") > 1)).count() == 0

    everything = materialise(diversity.alpha_diversity(table, 0, ["Taxon_name_entered"]))
    settings = scope.ScopeSettings(checked_columns=["Cropland_Minimal use", "Pop_density_1km_log"], min_sites_per_study=2)
    levels = {"level_1": ["Biome", "Custom_taxonomic_group"], "level_2": ["Realm"], "level_3": []}
    model = model_data.model_table(everything, alpha, settings, levels, 2, (["Pop_density_1km_log"], ["Cropland_Minimal use"]))
    split = materialise(model_data.fold_data(model, 3, "study", ["Biome"]))
    assert "Cropland_Minimal use x Pop_density_1km_log" in split.columns
    assert split.filter(F.col("Fold_id").isNull()).count() == 0
    report = folds.validate_folds(split, ["SSBS"], ["Custom_taxonomic_group"], 3).collect()
    assert len(report) == 3 and all(r.leak_free and r.duplicate_test_rows == 0 for r in report)
