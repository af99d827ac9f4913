"""From diversity tables to training data or cross-validation folds."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ecoframe.operators import folds, hierarchy, scope, transforms
from ecoframe.session import materialise


def model_table(
    df_all: DataFrame,
    df_scope: DataFrame | None,
    settings: scope.ScopeSettings,
    levels: dict[str, list[str]],
    min_studies: int,
    interactions: tuple[list[str], list[str]] = ([], []),
) -> DataFrame:
    """Scope, interaction terms, hierarchy labels and roll-up."""
    df = scope.model_scope(df_all, df_scope, settings)
    if interactions[0]:
        df, _ = transforms.interaction_terms(df, *interactions)
    df = materialise(hierarchy.hierarchy_labels(df, levels), "labelled")
    return hierarchy.hierarchical_rollup(df, levels, min_studies)


def fold_data(
    df: DataFrame, k: int, split_level: str, strata: list[str | None], seed: int = 42
) -> DataFrame:
    """The model table with its stratum and fold; study or site stays whole."""
    group = {"study": "SS", "site": "SSBS"}[split_level]
    return folds.assign_folds(materialise(folds.stratum(df, strata), "model"), k, group, seed)
