"""Pairs made from sites: same rows as joining to a pair list, and no shuffle of pairs."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from ecoframe.operators import composition, diversity, joins, sampling, scope, skew
from tests.conftest import SF
from tests.test_composition import SCHEMA, inventory

USES = [("Primary vegetation", "Minimal use"), ("Cropland", "Light use")]


def sites_of(spark, n=40, studies=2):
    rows = [(f"S{i % studies}", f"S{i % studies}_{i}", *USES[i % 3 > 0]) for i in range(n)]
    return spark.createDataFrame(rows, "SS string, SSBS string, Predominant_land_use string, Use_intensity string")


def everything(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("query", ["attach_pair_features", "haversine", "gower_pair", "gower_pair_global"])
def test_pairs_are_not_shuffled_for_their_features(spark, query):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = contract.queries()[query](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(Other_site" not in plan and "hashpartitioning(Primary_minimal_site" not in plan


def test_features_before_and_after_pairing_agree(spark):
    obs = sites_of(spark)
    sites = obs.select("SSBS").distinct().where("SSBS <> 'S1_7'").select(
        "SSBS", *[(F.xxhash64("SSBS") % k).cast("double").alias(c) for c, k in (("Latitude", 60), ("Longitude", 70), ("x", 9))]
    )
    want = joins.attach_pair_features(joins.site_pairs_with_reference(obs), sites, ["x"])
    got = joins.reference_pair_features(obs, sites, ["x"])
    assert sorted(want.columns) == sorted(got.columns) and everything(want) == everything(got)


def test_tasks_follow_the_number_of_pairs(spark):
    """Two sides of a few kB can make very many pairs; AQE alone puts them into one task."""
    side = spark.range(600).select((F.col("id") % 2).alias("k"), F.col("id").alias("a"))
    other = side.withColumnRenamed("a", "b")
    dealt = skew.blocked_join(side, other, ["k"], ["a"], ["b"], 50, 20_000)
    assert dealt.rdd.getNumPartitions() == 9
    assert dealt.distinct().count() == dealt.count() == 180_000


def test_rows_are_dealt_before_they_are_copied(spark, monkeypatch):
    """One small file of sites is one task, which alone had made all copies for the cells."""
    monkeypatch.setattr(skew, "COPIES_PER_TASK", 1_000, raising=False)
    side = spark.range(600).select((F.col("id") % 2).alias("k"), F.col("id").alias("a"))
    other = side.withColumnRenamed("a", "b")
    dealt = skew.blocked_join(side, other, ["k"], ["a"], ["b"], 50, 20_000)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    # 600 rows a side in 6 cells each make 3 600 copies.
    assert len(re.findall(r"hashpartitioning\(k#\d+L?, [ab]#\d+L?, 4\)", plan)) == 2
    assert dealt.rdd.getNumPartitions() == 9
    assert dealt.distinct().count() == dealt.count() == 180_000


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("taxa", [[], ["Family"]])
def test_scores_of_reference_pairs_need_no_pair_list(spark, monkeypatch, small, taxa):
    if small:
        for name, value in {"CELL_SITES": 3, "CELL_NODES": 7, "CELL_ENTRIES": 20, "PART_ENTRIES": 4, "BUCKET": 3, "WORD": 2, "PAIRS_PER_TASK": 30}.items():
            monkeypatch.setattr(composition, name, value)
    obs = spark.createDataFrame(inventory(5), SCHEMA)
    pairs = joins.site_pairs_with_reference(obs)
    want = diversity.bray_curtis_by_taxon(pairs, obs, taxa)
    got = diversity.reference_bray_curtis(obs, obs, taxa)
    text = lambda df: everything(df.withColumn("Bray_Curtis_score", F.round("Bray_Curtis_score", 9)))
    assert want.count() and text(want) == text(got)
    if taxa:
        assert everything(joins.shared_taxa(pairs, obs, taxa)) == everything(joins.reference_shared_taxa(obs, obs, taxa))


@pytest.mark.parametrize("query", ["bray_curtis", "bray_curtis_by_taxon", "bray_curtis_level_3", "shared_taxa"])
def test_taxa_of_pairs_do_not_shuffle_pairs(spark, query):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = contract.queries()[query](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CoGroups" not in plan and "hashpartitioning(Other_site" not in plan and "Primary_minimal_site#" not in "".join(
        line.split("Exchange ")[1] for line in plan.split("\n") if "Exchange " in line
    )


def test_counts_and_samples_of_pairs_come_from_sites(spark):
    rows = inventory(9) + [("b", "a3", "F1", "T1", 1.0, "Primary vegetation", "Minimal use"), ("b", "a4", "F1", "T1", 1.0, "Primary vegetation", "Light use"),
                           ("only", "o1", None, "T1", 1.0, "Primary vegetation", "Minimal use")]
    obs = spark.createDataFrame(rows, SCHEMA)
    pairs = joins.site_pairs_with_reference(obs).withColumnRenamed("Other_site", "SSBS")
    want = scope.scope_counts(pairs, "beta").first()
    got = joins.reference_pair_counts(obs).first()
    assert (got.studies, got.observations, got.site_pairs) == (want.studies, want.observations, want.site_pairs)
    assert got.observations > got.site_pairs  # one pair lies in two studies
    sampled = sampling.sample_reference_pairs(obs, 0.5, 3, 12)
    assert everything(sampled) == everything(sampling.sample_pairs_balanced(pairs, 0.5, 3, 12).select(*sampled.columns))


@pytest.mark.parametrize("query", ["scope_counts_pairs", "sample_pairs_balanced"])
def test_no_table_of_all_pairs_is_written(spark, monkeypatch, query):
    made = []
    plain = joins.site_pairs_with_reference
    monkeypatch.setattr(joins, "site_pairs_with_reference", lambda obs: made.append(plain(obs)) or made[-1])
    assert contract.queries()[query](spark, SF).count()
    # Only sites of several studies are paired, and there are none.
    assert all(m.count() == 0 for m in made)


@pytest.mark.parametrize("query", ["join_site_year", "combine_sources"])
def test_population_series_are_not_broadcast(spark, query):
    """37 rows a site from a census table that is small enough to broadcast itself."""
    plan = contract.queries()[query](spark, SF)._jdf.queryExecution().executedPlan().toString()
    sorted_joins = [line for line in plan.split("\n") if "SortMergeJoin [SSBS" in line and "Sample_year" in line]
    assert len(sorted_joins) == (1 if query == "join_site_year" else 3)
