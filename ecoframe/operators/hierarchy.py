"""Hierarchical groups, roll-up and index columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ecoframe.functions.nulls import col, label, n_unique
from ecoframe.operators.ranking import dense_index, rank_within
from ecoframe.operators.skew import attach
from ecoframe.session import materialise

POPULATION = "Population"


def label_names(levels: dict[str, list[str]]) -> dict[str, str]:
    """Name of the label column per level: its own columns after those of the levels above."""
    out, cols = {}, []
    for level, own in levels.items():
        if own:
            cols = cols + own
            out[level] = "_".join(cols)
    return out


def hierarchy_labels(df: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """Add the label columns; rows with a missing, blank or "null" label are dropped."""
    out, cols = df, []
    for level, name in label_names(levels).items():
        cols = cols + levels[level]
        if name not in out.columns:
            out = out.withColumn(name, label(*[col(c) for c in cols]))
        c = col(name)
        out = out.filter(c.isNotNull() & (F.length(F.trim(c)) > 0) & (F.lower(c) != "null"))
    return out


def hierarchy_mapping(df: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """Per level: label, index, number of studies and the label one level up."""
    names = label_names(levels)
    parts, parent = [], None
    for level, name in names.items():
        studies = df.groupBy(col(name).alias("label")).agg(
            n_unique(F.col("SS")).cast("long").alias("n_studies"),
            (F.min(col(parent)) if parent else F.lit(None).cast("string")).alias("parent"),
        )
        ranked = rank_within(studies, [], [F.col("label")])
        parts.append(
            ranked.select(
                F.lit(level).alias("level"), "label",
                F.col("position").cast("int").alias("idx"), "n_studies", "parent",
            )
        )
        parent = name
    return reduce(lambda a, b: a.unionByName(b), parts)


def hierarchical_rollup(df: DataFrame, levels: dict[str, list[str]], min_studies: int) -> DataFrame:
    """Assign every row to its deepest group with enough studies, else to the population.

    The assignment depends on the labels only, so it is worked out on distinct
    (labels, study) combinations; the rows meet the result in one join.
    """
    if min_studies < 2:
        raise ValueError("min_studies must be at least 2 for a roll-up")
    names = label_names(levels)
    labels = list(names.values())
    combos = df.select(*[col(n) for n in labels], "SS").distinct()
    work = combos
    for i, name in enumerate(labels):
        counts = combos.groupBy(col(name)).agg(n_unique(F.col("SS")).alias(f"__n{i}"))
        work = attach(work, counts, [name])
    group, lvl = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (level, name) in reversed(list(enumerate(names.items()))):
        enough = F.col(f"__n{i}") >= min_studies
        # Deeper levels come first in the coalesce.
        group = F.coalesce(group, F.when(enough, col(name)))
        lvl = F.coalesce(lvl, F.when(enough, F.lit(level)))
    assigned = work.select(*[col(n) for n in labels], "SS", group.alias("__g"), lvl.alias("__l"))
    remaining = assigned.groupBy("__g").agg(F.countDistinct("SS").alias("__left"))
    keep = F.col("__g").isNotNull() & (F.col("__left") >= min_studies)
    final = (
        attach(assigned, remaining, ["__g"])
        .select(
            *[col(n) for n in labels],
            F.when(keep, F.col("__g")).otherwise(F.lit(POPULATION)).alias("Final_hierarchical_group"),
            F.when(keep, F.col("__l")).otherwise(F.lit(POPULATION)).alias("Final_hierarchical_level"),
        )
        .distinct()
    )
    deepest = list(names)[-1]
    return attach(df, final, labels).withColumn(
        "Rolled_up", (F.col("Final_hierarchical_level") != deepest).cast("int")
    )


def rollup_mapping(df: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """Index of every final group; parents missing at their level get the next indices."""
    names = label_names(levels)
    order = list(names)
    parts = []
    for i, level in enumerate(order):
        own = (
            df.filter(F.col("Final_hierarchical_level") == level)
            .select(F.col("Final_hierarchical_group").alias("label"))
            .distinct()
            .withColumn("__late", F.lit(0))
        )
        groups = own
        if i + 1 < len(order):
            child = df.filter(F.col("Final_hierarchical_level") == order[i + 1])
            parents = child.select(col(names[level]).alias("label")).distinct()
            groups = own.unionByName(parents.join(own, "label", "left_anti").withColumn("__late", F.lit(1)))
        ranked = rank_within(groups, [], [F.col("__late"), F.col("label")])
        ranked = ranked.select(
            F.lit(level).alias("level"), "label", F.col("position").cast("int").alias("idx")
        )
        if i > 0:
            up = df.filter(F.col("Final_hierarchical_level") == level).groupBy(
                F.col("Final_hierarchical_group").alias("label")
            ).agg(F.min(col(names[order[i - 1]])).alias("parent"))
            ranked = ranked.join(up, "label", "left").select("level", "label", "idx", "parent")
        else:
            ranked = ranked.withColumn("parent", F.lit(None).cast("string"))
        parts.append(ranked)
    population = (
        df.filter(F.col("Final_hierarchical_level") == POPULATION)
        .select(F.lit(POPULATION).alias("level"), F.lit("None").alias("label"), F.lit(0).alias("idx"),
                F.lit(None).cast("string").alias("parent"))
        .distinct()
    )
    return reduce(lambda a, b: a.unionByName(b), parts + [population])


def model_index_columns(
    df: DataFrame, mapping: DataFrame, levels: dict[str, list[str]], taxon: str | None = None
) -> DataFrame:
    """Integer columns a hierarchical model is fed with."""
    names = label_names(levels)
    out = df
    for level, name in names.items():
        table = mapping.filter(F.col("level") == level).select(
            F.col("label").alias(name), F.col("idx").alias(f"{level}_idx")
        )
        out = attach(out, table, [name])
    if "Final_hierarchical_level" in df.columns:
        code = F.lit(0)
        for depth, level in enumerate(names, 1):
            code = F.when(F.col("Final_hierarchical_level") == level, F.lit(depth)).otherwise(code)
        out = out.withColumn("level_assignment", code)
    # Study, block and site indices meet in a table of one row per site, which joins the rows once.
    sites = materialise(df.select("SS", "SSB", "SSBS").distinct(), "sites")
    # The parent study of a block follows from the block itself, independent of row order.
    study = dense_index(sites, "SS", "study_idx")
    parents = attach(sites.groupBy("SSB").agg(F.min("SS").alias("SS")), study, ["SS"]).select(
        "SSB", F.col("study_idx").alias("block_to_study_idx")
    )
    indexed = sites
    for key, table in (
        ("SS", study),
        ("SSB", dense_index(sites, "SSB", "block_idx")),
        ("SSBS", dense_index(sites, "SSBS", "site_idx")),
        ("SSB", parents),
    ):
        indexed = attach(indexed, table, [key])
    out = attach(out, indexed, ["SS", "SSB", "SSBS"])
    if taxon:
        out = attach(out, dense_index(df, taxon, "taxon_idx"), [taxon])
    return out
