"""Edge cases on small hand-computed frames, and skew: hot keys are split, results unchanged."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ecoframe import config, session
from ecoframe.functions.stats import safe_corr, student_t_quantile
from ecoframe.operators import checks, diversity, evaluate, folds, geo, hierarchy, joins, neighbours, ranking, roads, sampling, scope, scoring, skew, transforms
from ecoframe.sources import tables

INF, NAN = float("inf"), float("nan")


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def obs(spark, data):
    """(study, site, taxon, measurement[, reference])"""
    full = [(s, f"{s}_b", site, t, float(m), float(m), "Abundance", 1.0, "Primary vegetation" if ref else "Cropland", "Minimal use") for s, site, t, m, ref in data]
    return spark.createDataFrame(
        full, "SS string, SSB string, SSBS string, Taxon_name_entered string, Measurement double, Effort_corrected_measurement double, "
        "Diversity_metric_type string, Sampling_effort double, Predominant_land_use string, Use_intensity string",
    )


# --- diversity ------------------------------------------------------------------------------


def test_single_taxon_and_zero_study(spark):
    df = obs(spark, [("s1", "a", "t1", 5, 1), ("s2", "b", "t1", 0, 1), ("s2", "b", "t2", 0, 1)])
    shannon = {r.SSBS: r for r in diversity.shannon_index(df, config.SITE_KEYS).collect()}
    assert shannon["a"].Shannon_index == 0.0
    total = {r.SSBS: r for r in diversity.total_abundance(df, config.SITE_KEYS).collect()}
    assert total["b"].Total_abundance == 0 and total["b"].Scaled_Total_abundance == 0.0


def test_shannon_matches_definition(spark):
    counts = [3, 4, 0, 10]
    df = obs(spark, [("s", "a", f"t{i}", c, 1) for i, c in enumerate(counts)])
    h = -sum(c / 17 * math.log(c / 17) for c in counts if c)
    row = diversity.shannon_index(df, config.SITE_KEYS).first()
    assert row.Shannon_index == pytest.approx(h, abs=1e-12)
    assert row.Modified_Shannon_index == pytest.approx(math.log(18) * h, abs=1e-12)


def test_other_metric_types_count_for_the_geometric_maximum_only(spark):
    df = obs(spark, [("s", "a", "t1", 1, 1), ("s", "b", "t1", 9, 1)]).withColumn(
        "Diversity_metric_type", F.when(F.col("SSBS") == "b", "Occurrence").otherwise("Abundance")
    )
    out = diversity.alpha_diversity(df, 0, ["Taxon_name_entered"], []).collect()
    assert [r.SSBS for r in out] == ["a"]
    assert out[0].Study_max_Total_abundance == 1 and out[0].Study_max_Geometric_mean_abundance == pytest.approx(9)


def test_bray_curtis_edges(spark):
    df = obs(spark, [
        ("s", "r", "t1", 4, 1), ("s", "r", "t2", 6, 1),
        ("s", "same", "t1", 4, 0), ("s", "same", "t2", 6, 0),
        ("s", "none", "t3", 5, 0), ("s", "zero", "t1", 0, 0),
        ("s", "twice", "t1", 1, 0), ("s", "twice", "t1", 2, 0),
        ("z", "r0", "t1", 0, 1), ("z", "o0", "t1", 0, 0),
    ])
    got = {r.Other_site: r.Bray_Curtis_score for r in diversity.bray_curtis(joins.site_pairs_with_reference(df), df).collect()}
    # A repeated taxon name meets the other site's row once per repetition.
    assert got == {"same": 1.0, "none": 0.0, "zero": 0.0, "twice": pytest.approx(2 * 3 / 13), "o0": None}


def test_reference_pairs_once_and_never_with_self(spark):
    df = obs(spark, [("s", x, "t", 1, x in "ab") for x in "abc"])
    assert rows(joins.site_pairs_with_reference(df)) == [("s", "a", "b"), ("s", "a", "c"), ("s", "b", "c")]


def test_eligible_studies_counts_null_as_a_value(spark):
    df = obs(spark, [(s, f"{s}1", t, 1, 1) for s in ("mixed", "nulls", "fine", "one") for t in ("t1", "t2")])
    df = df.withColumn("Sampling_effort", F.when((F.col("SS") == "mixed") & (F.col("Taxon_name_entered") == "t1"), None)
                       .when(F.col("SS") == "nulls", None).otherwise(1.0))
    df = df.filter((F.col("SS") != "one") | (F.col("Taxon_name_entered") == "t1"))
    assert rows(joins.eligible_studies(df)) == [("fine",), ("nulls",)]


def test_imputation_levels(spark):
    data = [("s1", "b1", 1.0), ("s1", "b1", None), ("s1", "b2", NAN), ("s1", "b2", INF), ("s2", "b3", None), ("s3", "b4", 7.0), ("s3", None, None)]
    df = spark.createDataFrame(data, "SS string, SSB string, x double").withColumn("i", F.monotonically_increasing_id())
    got = [r.x for r in diversity.impute_hierarchical(df, ["x"]).orderBy("i").collect()]
    # block b1 -> 1; study s1 (block-imputed 1, 1) -> 1; a null block falls through to its study;
    # global over the study-imputed rows (1, 1, 1, 1, 7, 7) -> 3
    assert got == [1.0, 1.0, 1.0, 1.0, 3.0, 7.0, 7.0]


def test_zero_census_carries_the_previous_value(spark):
    df = spark.createDataFrame([("a", 10.0, 0.0, 20.0, 20.0, 40.0), ("b", 0.0, 5.0, 5.0, 5.0, 5.0), ("c", None, 1.0, 1.0, 1.0, 1.0)],
                               "SSBS string, p2000 double, p2005 double, p2010 double, p2015 double, p2020 double")
    out = {(r.SSBS, r.Year): r.v for r in diversity.interpolate_population(df, "p", name="v").collect()}
    assert len(out) == 3 * 37
    assert out["a", 1984] == 10 and out["a", 2005] == 10 and out["a", 2010] == pytest.approx(20)
    assert out["a", 2018] == pytest.approx(20 * 2 ** 0.6)
    assert out["b", 2005] == 0 and out["b", 2020] == 0 and out["c", 1990] is None


# --- transforms and scope -------------------------------------------------------------------


def test_transforms_edge_values(spark):
    df = spark.createDataFrame([(-8.0,), (0.0,), (None,)], "x double")
    out, names = transforms.nonlinear_transforms(df, ["x"], ["x"])
    assert names == ["x_log", "x_sqrt", "x_cbrt", "x_square"]
    first = out.first()
    assert first.x_log is None and math.isnan(first.x_sqrt) and math.isnan(first.x_cbrt) and first.x_square == 64
    assert transforms.drop_invalid_rows(out, ["x_log", "x_cbrt", "absent"]).count() == 1


def test_null_kingdom_is_dropped_and_labels_stay_null(spark):
    df = spark.createDataFrame([("Chordata", "Reptilia", "Animalia"), (None, None, None), (None, None, "Protozoa")], "Phylum string, Class string, Kingdom string")
    assert rows(transforms.custom_taxon_group(df), "Custom_taxonomic_group") == [("Amphibia_Reptilia",), ("Other Protozoa",)]
    lui = spark.createDataFrame([("Urban", None)], "Predominant_land_use string, Use_intensity string")
    assert transforms.land_use_intensity(lui).first().LU_type_intensity is None


def test_scope_filters(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "x")], "Biome string, Realm string")
    assert transforms.filter_scope(df, "exclude", {"Biome": ["a"]}).count() == 1
    with pytest.raises(ValueError):
        transforms.filter_scope(df, "other", {})
    kept = transforms.filter_taxonomic_scope(df.withColumnRenamed("Biome", "Custom_taxonomic_group"), "Custom", "include", {"Custom": ["a"], "Kingdom": ["none"]})
    assert kept.count() == 1


def test_outlier_bound_is_inclusive(spark):
    df = spark.createDataFrame([("s", f"p{i}", float(v)) for i, v in enumerate([1, 1, 1, 1, 2])], "SS string, SSBS string, y double")
    assert scope.filter_outliers_iqr(df, "y", 1.5, ["SSBS"]).count() == 4


def test_many_to_one_rejects_repeated_keys(spark):
    left = spark.createDataFrame([("a",)], "k string")
    right = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    with pytest.raises(Exception, match="not unique"):
        joins.join_many_to_one(left, right, ["k"]).collect()


# --- ranks and quantiles --------------------------------------------------------------------


def test_rank_bins_edges(spark):
    for n, k in ((3, 4), (10, 4), (23, 10)):
        df = spark.createDataFrame([(1.0, i) for i in range(n)], "v double, i int")
        edges = [i * n // k for i in range(k + 1)]
        want = [next(b for b in range(k) if edges[b] <= i < edges[b + 1]) for i in range(n)]
        assert [r.bin for r in ranking.rank_bins(df, "v", k, ["i"]).orderBy("i").collect()] == want


@pytest.mark.parametrize("method", ["nearest", "linear"])
def test_quantiles_with_a_hot_key_and_hot_value(spark, method):
    rnd = random.Random(1)
    data = [("hot", 0.0) for _ in range(700)] + [("hot", rnd.random()) for _ in range(1300)]
    data += [(f"k{i % 7}", rnd.gauss(0, 1)) for i in range(400)] + [("nulls", None), ("one", 4.0)]
    df = spark.createDataFrame(data, "k string, v double").repartition(6)
    got = {r.k: (r.a, r.b) for r in ranking.quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.9}, method).collect()}
    groups = {}
    for k, v in data:
        if v is not None:
            groups.setdefault(k, []).append(v)
    assert set(got) == set(groups)
    for k, values in groups.items():
        values.sort()
        for q, have in zip((0.25, 0.9), got[k]):
            at = (len(values) - 1) * q
            if method == "nearest":
                want = values[math.floor(at + 0.5)]
            else:
                low = math.floor(at)
                want = values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)
            assert have == pytest.approx(want, abs=1e-12)


def test_average_rank_and_running_weight(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 2.0), ("b", 5.0), ("b", None)], "k string, v double")
    assert sorted((r.k, r.v or -1, r.avg_rank or -1) for r in ranking.average_rank(df, "v", ["k"]).collect()) == [
        ("a", 1.0, 1.5), ("a", 1.0, 1.5), ("a", 2.0, 3.0), ("b", -1, -1), ("b", 5.0, 1.0)]


def test_blocked_join_equals_plain_join(spark):
    left = spark.createDataFrame([("hot", i) for i in range(60)] + [("x", 1), (None, 2)], "k string, a int")
    right = spark.createDataFrame([("hot", i) for i in range(90)] + [("x", 7), (None, 3)], "k string, b int")
    got = skew.blocked_join(left, right, ["k"], ["a"], ["b"], block_rows=16)
    assert rows(got, "k", "a", "b") == rows(left.join(right, "k"), "k", "a", "b")
    assert got.count() == 60 * 90 + 1


def test_attributes_per_key_equal_first_rows(spark):
    same = [("a", 1, "x", i) for i in range(9)] + [("b", 2, None, i) for i in range(5)] + [(None, 3, "z", 0)]
    schema = "k string, n int, s string, o int"
    for extra in ([], [("c", 5, "late", 4), ("c", 4, "first", 1), (None, 9, "w", 7)]):
        df = spark.createDataFrame(same + extra, schema)
        want = ranking.first_per_key(df, ["k"], ["o"]).drop("o")
        got = ranking.attributes_per_key(df, ["k"], ["n", "s"], ["o"])
        assert sorted(map(repr, got.select("k", "n", "s").collect())) == sorted(map(repr, want.select("k", "n", "s").collect()))


def test_outer_widening_keeps_every_site(spark):
    a = spark.createDataFrame([("s1", 1.0), ("s2", 2.0)], "SSBS string, one double")
    b = spark.createDataFrame([("s2", 3.0), ("s3", 4.0)], "SSBS string, ten double")
    assert rows(joins.widen_by_site([a, b]), "SSBS") == [("s1",), ("s2",), ("s3",)]


# --- evaluation -----------------------------------------------------------------------------


def test_constant_predictions_have_no_correlation(spark):
    df = spark.createDataFrame([(float(i), 0.5) for i in range(8)], "Observed double, Predicted double").withColumn("i", F.monotonically_increasing_id())
    assert df.agg(safe_corr(F.col("Observed"), F.col("Predicted"))).first()[0] is None
    out = {r.segment: r for r in evaluate.performance_metrics(df, ["i"]).collect()}
    assert out["overall"].pearson_corr is None and out["overall"].spearman_corr is None and out["bottom"].n == 2


@pytest.mark.parametrize("block", [4, 16, 512])
def test_exact_neighbours_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE_ROWS", block)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 2 * block)
    rnd = random.Random(3)
    data = [("g" if i < 120 else "h", i, rnd.random(), rnd.gauss(0, 2), 1.0) for i in range(130)]
    df = spark.createDataFrame(data, "grp string, id int, x double, y double, c double")
    got = {r.id: r.gower_distance for r in evaluate.gower_knn_exact(df, ["grp"], ["x", "y", "c"], "id", 5, "median").collect()}
    for g in "gh":
        part = [d for d in data if d[0] == g]
        width = [max(d[j] for d in part) - min(d[j] for d in part) for j in (2, 3, 4)]
        for a in part:
            dist = sorted(sum(abs(a[j + 2] - b[j + 2]) / w for j, w in enumerate(width) if w) / 3 for b in part if b is not a)[:5]
            assert got[a[1]] == pytest.approx(dist[2], abs=1e-9)


def test_delta_skips_repeated_sites_and_orients_references(spark):
    pred = spark.createDataFrame([("a", 1.0, 1.0), ("b", 3.0, 2.0), ("c", 0.0, 0.0), ("c", 1.0, 1.0)], "SSBS string, Observed double, Predicted double")
    info = spark.createDataFrame([("a", "s", "Cropland", "Light use"), ("b", "s", "Primary vegetation", "Minimal use"), ("c", "s", "Pasture", "Light use")],
                                 "SSBS string, SS string, Predominant_land_use string, Use_intensity string")
    assert rows(evaluate.delta_predictions(pred, info, "SS", "Predicted"), "site_1", "site_2", "residual") == [("a", "b", -1.0)]
    assert rows(evaluate.delta_predictions(pred, info, "SS", "Predicted", ref_only=True), "site_1", "site_2", "Observed") == [("b", "a", -2.0)]


def test_regressions(spark):
    df = spark.range(50).select((F.col("id") / 10.0).alias("x"), (F.col("id") % 7).cast("double").alias("z"))
    df = df.withColumn("y", 1 + 2 * F.col("x") - 0.5 * F.col("x") ** 3)
    cubic = evaluate.polyfit(df, "x", "y", 3)
    assert cubic.select(F.max(F.abs(F.col("y") - (1 + 2 * F.col("x") - 0.5 * F.col("x") ** 3)))).first()[0] < 1e-8
    line = df.withColumn("y", 3 + 2 * F.col("x") + F.col("z"))
    fit = {r.term: r for r in evaluate.ols_standardised(line, "y", ["x", "z"]).collect()}
    sx = line.agg(F.stddev_samp("x")).first()[0]
    assert fit["x"].estimate == pytest.approx(2 * sx) and fit["x"].significant == "*"
    assert student_t_quantile(0.975, 10) == pytest.approx(2.2281388, abs=1e-6)


# --- hierarchy and folds --------------------------------------------------------------------


def test_rollup_levels(spark):
    data = [("A", "x", f"s{i}") for i in range(6)] + [("A", "y", f"t{i}") for i in range(4)] + [("A", "z", "u0"), ("B", "x", "v0")]
    df = spark.createDataFrame(data, "Biome string, Realm string, SS string")
    levels = {"level_1": ["Biome"], "level_2": ["Realm"], "level_3": []}
    out = hierarchy.hierarchical_rollup(hierarchy.hierarchy_labels(df, levels), levels, 5)
    got = {(r.Biome, r.Realm): (r.Final_hierarchical_group, r.Rolled_up) for r in out.collect()}
    assert got == {("A", "x"): ("A_x", 0), ("A", "y"): ("A", 1), ("A", "z"): ("A", 1), ("B", "x"): ("Population", 1)}
    mapping = {(r.level, r.label): (r.idx, r.parent) for r in hierarchy.rollup_mapping(out, levels).collect()}
    assert mapping == {("level_1", "A"): (0, None), ("level_2", "A_x"): (0, "A"), ("Population", "None"): (0, None)}
    with pytest.raises(ValueError):
        hierarchy.hierarchical_rollup(df, levels, 1)


def test_a_study_in_two_strata_stays_in_one_fold(spark):
    data = [(f"s{i}", f"s{i}_{j}", "p" if (i + j) % 3 else "q") for i in range(12) for j in range(i + 1)]
    df = spark.createDataFrame(data, "SS string, SSBS string, Biome string")
    out = folds.assign_folds(folds.stratum(df, ["Biome"]), 3, "SS")
    assert out.count() == len(data)
    assert out.groupBy("SS").agg(F.countDistinct("Fold_id").alias("n")).filter("n <> 1").count() == 0
    report = folds.validate_folds(out, ["SSBS"], [], 3).collect()
    assert len(report) == 3 and all(r.leak_free and r.overlap_studies == 0 for r in report)


def test_small_strata_fill_all_folds(spark):
    df = spark.createDataFrame([(f"s{i}", f"b{i}") for i in range(20) for _ in range(3)], "SS string, Stratum string")
    sizes = folds.assign_folds(df, 5, "SS").groupBy("Fold_id").count().collect()
    assert sorted((r.Fold_id, r["count"]) for r in sizes) == [(k, 12) for k in range(5)]


def test_spread_around_a_large_mean(spark):
    df = spark.range(700).select((F.col("id") % 5).cast("int").alias("Fold_id"), (1e9 + (F.col("id") % 7) * 0.001).alias("x"))
    scaled = folds.standardise_folds(df, ["x"], 5).filter("role = 'train'")
    assert all(r.s == pytest.approx(1, abs=1e-3) for r in scaled.groupBy("fold").agg(F.stddev_pop("x").alias("s")).collect())
    near = df.withColumn("x", 1e8 + (F.col("Fold_id") + 1) * 0.01)
    assert evaluate.kde_by_fold(near, "x", 5, 20).filter("density IS NULL").select("role").distinct().collect() == [("test",)]


def test_rows_without_draws_stay(spark):
    draws = spark.createDataFrame(
        [(c, d, lv, g, float(lv + g), [0.5]) for c in range(2) for d in range(90) for lv, g in ((0, 0), (1, 1))],
        "chain int, draw int, level int, group int, alpha double, beta array<double>",
    )
    df = spark.createDataFrame([("a", 1, 1, 2.0), ("b", 1, 9, 2.0), ("c", 0, 0, 2.0)], "SSBS string, level int, group int, x double")
    got = {r.SSBS: r.Predicted for r in scoring.score_hierarchical(df, draws, ["SSBS"], ["x"], "gaussian").collect()}
    assert got == pytest.approx({"a": 3.0, "b": 1.0, "c": 1.0})
    counts = {r.SSBS: r["count"] for r in scoring.predictive_distribution(df, draws, ["SSBS"], ["x"]).groupBy("SSBS").count().collect()}
    assert counts == {"a": 180, "b": 180, "c": 180}
    with pytest.raises(Exception, match="no draws"):
        scoring.score_hierarchical(df, draws, ["SSBS"], ["x"], missing="error").collect()
    with pytest.raises(ValueError):
        scoring.score_hierarchical(df, draws, ["SSBS"], ["x"], missing="drop")


def test_all_references_are_searched_by_default(spark):
    query = spark.createDataFrame([(-1, 0.0)], "id int, x double")
    reference = spark.range(5000).select(F.col("id").cast("int"), (1.0 + F.col("id")).alias("x"))
    got = evaluate.gower_knn(query, reference, ["x"], "id", 1).first()
    assert got.gower_distance == pytest.approx(1 / 5000)
    some = evaluate.gower_knn(query, reference, ["x"], "id", 1, max_ref=10).first()
    assert some.gower_distance > got.gower_distance
    with pytest.raises(ValueError):
        evaluate.gower_knn(query, reference, ["x"], "id", selection="random")


def test_empty_bins_and_sections_are_listed(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.0,)], "x double")
    assert rows(evaluate.histogram(df, ["x"], 5), "bin", "n") == [(0, 1), (1, 0), (2, 0), (3, 0), (4, 2)]
    few = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 2.0)], "i int, Observed double, Predicted double")
    out = {r.section: r.n for r in evaluate.bias_ratios(few, ["i"]).collect()}
    assert len(out) == 13 and out["overall"] == 2 and sum(out[f"decile_{k}"] for k in range(1, 11)) == 2


def test_spearman_of_ties_against_ranks(spark):
    rnd = random.Random(5)
    data = [(g, float(rnd.randint(0, 6)), float(rnd.randint(0, 4))) for g in "ab" for _ in range(80)] + [("a", None, 1.0)]
    got = {r.g: r.spearman_corr for r in evaluate.spearman(spark.createDataFrame(data, "g string, x double, y double"), ["g"], "x", "y").collect()}
    for g in "ab":
        frame = pd.DataFrame([d[1:] for d in data if d[0] == g and d[1] is not None]).rank()
        assert got[g] == pytest.approx(frame[0].corr(frame[1]), abs=1e-12)
    assert evaluate.spearman(spark.createDataFrame([(1.0, 1.0)], "x double, y double"), [], "x", "y").first()[0] is None


def test_regressions_refuse_degenerate_input(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(9)], "y double, x double")
    with pytest.raises(ValueError, match="without spread"):
        evaluate.ols_standardised(df, "y", ["x"])
    with pytest.raises(ValueError, match="too few"):
        evaluate.ols_standardised(df.limit(1), "y", ["x"])
    with pytest.raises(ValueError, match="No finite"):
        evaluate.polyfit(df.withColumn("x", F.lit(NAN)), "x", "y")


def test_zero_spread_scales_with_one(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    test = spark.createDataFrame([(5.0, 6.0), (NAN, None)], "a double, b double")
    assert rows(folds.standardise(train, test, ["a", "b"])[1].fillna(-9.0)) == [(0.0, -9.0), (3.0, 1.0)]


# --- geometry -------------------------------------------------------------------------------


def test_utm_round_trip_and_known_point(spark):
    pts = [(179.9, 60.0), (-179.9, -60.0), (-79.3871389, 43.6425667), (0.0, 0.0), (-75.5, -33.25)]
    df = spark.createDataFrame(pts, "Longitude double, Latitude double")
    p = geo.project_utm(df)
    back = geo.unproject_utm(p.withColumnsRenamed({"Longitude": "lon0", "Latitude": "lat0"}))
    assert back.select(F.max(F.abs(F.col("Longitude") - F.col("lon0")) + F.abs(F.col("Latitude") - F.col("lat0")))).first()[0] < 1e-9
    tower = p.filter("Latitude between 43 and 44").first()
    assert tower.epsg_code == 32617
    assert tower.easting == pytest.approx(630084, abs=1) and tower.northing == pytest.approx(4833438, abs=1)
    zones = {r.Longitude: r.utm_zone for r in p.collect()}
    assert zones[179.9] == 60 and zones[-179.9] == 1
    bergen = spark.createDataFrame([(5.3, 60.4)], "Longitude double, Latitude double")
    assert geo.utm_zone(bergen).first().utm_zone == 31 and geo.utm_zone(bergen, exceptions=True).first().utm_zone == 32


def test_buffers_and_road_length_of_a_chord(spark):
    site = spark.createDataFrame([("a", 32631, 5000.0, 5000.0)], "SSBS string, epsg_code int, easting double, northing double")
    square = geo.buffer_sites(site, [2], "square").first().polygon
    area = sum(p.x * q.y - q.x * p.y for p, q in zip(square, square[1:])) / 2
    assert area == pytest.approx(4000.0**2)
    lines = [(32631, -9000.0, 5600.0, 19000.0, 5600.0), (32631, 19000.0, 5600.0, -9000.0, 5600.0), (32632, 0.0, 5000.0, 9000.0, 5000.0), (32631, 4900.0, 5000.0, 5100.0, 5000.0)]
    segs = spark.createDataFrame(lines, "epsg_code int, x1 double, y1 double, x2 double, y2 double")
    round_buffer = geo.buffer_sites(site, [1], "round").select("SSBS", "epsg_code", "polygon")
    length = roads.road_density(round_buffer, segs, ["SSBS"], 7.0).first().Road_density
    # The reversed copy and the other zone do not count.
    assert length == pytest.approx(2 * math.sqrt(1000**2 - 600**2) + 200, rel=0.01)


def test_zonal_stats_against_brute_force(spark):
    rnd = random.Random(5)
    grid = [("r", x, y, rnd.random()) for x in range(12) for y in range(12)]
    pixels = spark.createDataFrame(grid, "raster_id string, ix int, iy int, value double")
    sites = spark.createDataFrame([("in", 5.3, 6.1, 2.4), ("out", 50.0, 50.0, 1.0)], "SSBS string, x double, y double, r double")
    polys = sites.withColumn("polygon", geo.buffer_polygon(F.col("x"), F.col("y"), F.col("r"), "round")).select("SSBS", "polygon")
    got = {r.SSBS: r.r for r in geo.zonal_stats(polys, pixels, ["SSBS"], ["r"], all_touched=False).collect()}
    apothem = [(math.cos(2 * math.pi * (i + 0.5) / 32), math.sin(2 * math.pi * (i + 0.5) / 32)) for i in range(32)]
    inside = [v for _, x, y, v in grid if all((x + 0.5 - 5.3) * a + (y + 0.5 - 6.1) * b <= 2.4 * math.cos(math.pi / 32) for a, b in apothem)]
    assert got["in"] == pytest.approx(sum(inside) / len(inside)) and got["out"] is None


def test_multilines(spark):
    df = spark.createDataFrame([(1, [[(0.0, 0.0), (1.0, 1.0)], [(5.0, 5.0)]])], "id int, parts array<array<struct<x:double,y:double>>>")
    assert rows(geo.line_segments(geo.split_multilines(df)), "x1", "y1", "x2", "y2") == [(0.0, 0.0, 1.0, 1.0)]


# --- checks and files -----------------------------------------------------------------------


def test_duplicates_and_unique(spark):
    df = spark.createDataFrame([(1, 4), (2, 5), (2, 5), (3, 6)], "col1 int, col2 int")
    assert checks.duplicate_rows(df).first()[0] == 2 and checks.duplicate_rows(df, "extras").first()[0] == 1
    assert checks.unique_count(spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "a int"), "a").first()[0] == 4


def test_csv_without_schema_and_write_rules(spark, tmp_path):
    (tmp_path / "a.csv").write_text("SS,x,y\ns1,1,2.5\ns2,NA,NA\n")
    df = tables.read_inventory_csv(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes)["y"] == "double" and rows(df.fillna(-1), "x") == [(-1,), (1,)]
    with pytest.raises(ValueError):
        tables.write_table(df.filter("SS = 'none'"), str(tmp_path / "t"))
    tables.write_table(df, str(tmp_path / "t"))
    with pytest.raises(Exception):
        tables.write_table(df, str(tmp_path / "t"))
    tables.write_table(df, str(tmp_path / "t"), overwrite=True)


def test_csv_types_come_from_all_rows(spark, tmp_path):
    """A value of another type far down neither is lost nor breaks the reading."""
    for name, last in (("a", "7"), ("b", "2.5")):
        (tmp_path / f"{name}.csv").write_text("x,y\n" + "1,k\n" * 120_000 + f"{last},NA\n")
    paths = [str(tmp_path / f"{n}.csv") for n in "ab"]
    df = tables.read_inventory_csv(spark, paths)
    assert df.schema["x"].dataType.simpleString() == "double"
    assert df.filter("x = 2.5").count() == 1 and df.filter("x IS NULL").count() == 0 and df.filter("y IS NULL").count() == 2
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        tables.read_inventory_csv(spark, paths, "x int, y string").agg(F.sum("x")).collect()


def test_training_predictions_are_read(spark, tmp_path):
    rows_ = spark.createDataFrame([("s", 1.0)], "SSBS string, Predicted double")
    rows_.write.parquet(str(tmp_path / "key_output" / "train_predictions.parquet"))
    assert rows(tables.read_predictions(spark, str(tmp_path), "training")) == [("s", 1.0, "Training")]


def test_scratch_folder_is_shared_and_freed(spark):
    class Cluster:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Cluster()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError, match="checkpoint"):
        session.scratch_root(Session())
    stage = session.materialise(spark.range(5))
    path = stage.inputFiles()[0]
    assert stage.count() == 5
    session.release(stage)
    with pytest.raises(Exception, match="does not exist|PATH_NOT_FOUND|FAILED_READ"):
        spark.read.parquet(path).count()
    with pytest.raises(ValueError):
        session.release(stage)


# --- plans ----------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["alpha_diversity", "bray_curtis", "impute_hierarchical", "quantile_nearest", "rank_bins",
                                  "performance_metrics", "score_mixed", "road_density", "zonal_stats", "hierarchical_rollup"])
def test_plans_have_no_cartesian_product_or_python(spark, name):
    import __spark_entry__ as contract
    from tests.conftest import SF

    plan = contract.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python"):
        assert node not in plan


@pytest.mark.parametrize("name", ["alpha_diversity", "site_info", "join_many_to_one", "site_points", "join_predictions_site_info"])
def test_whole_rows_are_not_sorted_to_pick_one(spark, name):
    import __spark_entry__ as contract
    from tests.conftest import SF

    assert "SortAggregate" not in contract.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_row_operators_accept_a_stream(spark, tmp_path):
    df = spark.createDataFrame([("Cropland", "Light use")], "Predominant_land_use string, Use_intensity string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = transforms.land_use_rollup_flags(transforms.land_use_intensity(stream))
    query = out.writeStream.format("memory").queryName("flags").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("flags").first()["Cropland_Light_Intense"] == 1


def test_quarters_sort_only_rows_on_edges(spark, monkeypatch):
    """Ties over several bins, nulls, one key of one value: bins as by rank, with few rows sorted."""
    values = [("a", v, i) for i, v in enumerate([1.0] * 37 + [2.0] * 3 + [3.0] * 60 + [None] * 5)]
    values += [("b", 5.0, i) for i in range(10)] + [("c", float(i * 7 % 101), i) for i in range(101)] + [(None, 1.0, i) for i in range(3)]
    df = spark.createDataFrame(values, "k string, v double, i int")
    want = sorted(map(str, ranking.rank_bins(df, "v", 4, ["i"], ["k"]).collect()))
    ranked = []
    plain = ranking.rank_within
    monkeypatch.setattr(evaluate, "rank_within", lambda rows, *rest: ranked.append(rows.count()) or plain(rows, *rest))
    assert sorted(map(str, evaluate._quarters(df, "v", ["i"], ["k"]).collect())) == want
    # Values 1.0 and 3.0 and the null of "a", all of "b" and of the null key; no edge falls inside a single row.
    assert sum(ranked) < 125 and sum(ranked) < df.count() / 1.5
