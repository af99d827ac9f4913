from __future__ import annotations

from pyspark.sql import functions as F

from ecoframe.operators import checks as c, joins as j
from ecoframe.session import materialise
from registry.base import PARTS, query


@query(
    "duplicate_rows",
    "SELECT CAST(coalesce(sum(CASE WHEN n > 1 THEN n ELSE 0 END), 0) AS BIGINT) AS n_duplicates FROM (SELECT count(*) AS n FROM {predictions} GROUP BY Observed, Predicted_FE, fold, SSBS) t",
)
def _(v):
    return c.duplicate_rows(v("predictions").select("Observed", "Predicted_FE", "fold", "SSBS"))


@query(
    "duplicate_rows_extras",
    "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_duplicates FROM (SELECT count(*) AS n FROM {predictions} GROUP BY Observed, Predicted_FE, fold, SSBS) t",
)
def _(v):
    return c.duplicate_rows(v("predictions").select("Observed", "Predicted_FE", "fold", "SSBS"), "extras")


@query("unique_count", "SELECT count(DISTINCT Kingdom) + max(CASE WHEN Kingdom IS NULL THEN 1 ELSE 0 END) AS n_unique FROM {site_obs}")
def _(v):
    return c.unique_count(v("site_obs"), "Kingdom")


@query(
    "check_ranges",
    """SELECT 'Observed' AS "column", 'within_0_1' AS rule, CAST(count(*) FILTER (Observed < 0 OR Observed > 1) AS BIGINT) AS violations FROM {predictions}
       UNION ALL SELECT 'Predicted_FE', 'within_0_0.5', count(*) FILTER (Predicted_FE < 0 OR Predicted_FE > 0.5) FROM {predictions}
       UNION ALL SELECT 'Observed', 'no_nan', 0 UNION ALL SELECT 'Predicted_RE', 'non_negative', count(*) FILTER (Predicted_RE < 0) FROM {predictions}""",
)
def _(v):
    rules = [c.within("Observed"), c.within("Predicted_FE", 0.0, 0.5), c.no_nan("Observed"), c.non_negative("Predicted_RE")]
    return c.check_ranges(v("predictions"), rules)


# Diversity results with planted faults: scaled values over 1, a negative value and NaN.
PARTS["faulty_alpha"] = """
    SELECT SSBS, CASE c_custkey % 11 WHEN 0 THEN -1e0 WHEN 1 THEN CAST('NaN' AS DOUBLE) ELSE c_custkey % 5 * 1e0 END AS Total_abundance,
      CASE c_custkey % 13 WHEN 0 THEN 1.5e0 WHEN 1 THEN CAST('NaN' AS DOUBLE) ELSE 5e-1 END AS Scaled_Total_abundance,
      CASE c_custkey % 17 WHEN 0 THEN -2e0 ELSE 4e0 END AS Study_max_Total_abundance FROM {site_base}"""


def _faulty_alpha(v):
    k, nan = F.col("c_custkey"), F.lit(float("nan"))
    return v("site_base").select(
        "SSBS", F.when(k % 11 == 0, -1.0).when(k % 11 == 1, nan).otherwise((k % 5).cast("double")).alias("Total_abundance"),
        F.when(k % 13 == 0, 1.5).when(k % 13 == 1, nan).otherwise(0.5).alias("Scaled_Total_abundance"),
        F.when(k % 17 == 0, -2.0).otherwise(4.0).alias("Study_max_Total_abundance"),
    )


_ALPHA_RULES = [
    ("Total_abundance", "no_nan", "isnan({c})"), ("Scaled_Total_abundance", "no_nan", "isnan({c})"), ("Study_max_Total_abundance", "no_nan", "isnan({c})"),
    ("Total_abundance", "non_negative", "{c} < 0"), ("Study_max_Total_abundance", "non_negative", "{c} < 0"),
    ("Scaled_Total_abundance", "within_0_1", "{c} < 0 OR {c} > 1"),  # NaN is above all numbers in both engines
]


@query(
    "check_alpha",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{rule}' AS rule, count(*) FILTER ({test.format(c=c)}) AS violations FROM {{faulty_alpha}}" for c, rule, test in _ALPHA_RULES
    ),
)
def _(v):
    return c.check_alpha(_faulty_alpha(v), "Total_abundance")


_COLUMNS = ["SSBS", "Taxon_name_entered", "Measurement"]


# The second release repeats some rows of the first.
PARTS["release_b"] = "SELECT SSBS, Taxon_name_entered, Measurement FROM {inventory_b} UNION ALL SELECT SSBS, Taxon_name_entered, Measurement FROM {inventory_a} WHERE c_custkey % 9 = 0"
PARTS["released"] = "SELECT SSBS, Taxon_name_entered, Measurement FROM {inventory_a} UNION ALL SELECT * FROM {release_b}"


@query(
    "check_concat",
    """SELECT true AS columns_match, (SELECT CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) FROM (SELECT count(*) AS n FROM {released} GROUP BY SSBS, Taxon_name_entered, Measurement) g) AS n_duplicates,
         count(*) - (SELECT count(*) FROM {inventory_a}) - (SELECT count(*) FROM {release_b}) AS row_difference,
         count(DISTINCT SSBS) - (SELECT count(DISTINCT SSBS) FROM {inventory_a}) - (SELECT count(DISTINCT SSBS) FROM {release_b}) AS site_difference FROM {released}""",
)
def _(v):
    # Both releases are stored tables for the check, which reads each of them several times.
    first = materialise(v("inventory_a").select(*_COLUMNS, "only_in_a", "c_custkey"), "release")
    a = first.drop("c_custkey")
    repeated = first.filter("c_custkey % 9 = 0").select(*_COLUMNS)
    second = materialise(v("inventory_b").select(*_COLUMNS), "release")
    b = second.unionByName(repeated).withColumn("only_in_b", F.lit("new"))
    return c.check_concat(a, b, j.concat_releases(a, b, _COLUMNS))


PARTS["faulty_sites"] = """
    SELECT CASE WHEN c_custkey % 7 = 0 THEN 'S0' ELSE SSBS END AS SSBS, CASE WHEN c_custkey % 10 <> 3 THEN Longitude END AS Longitude,
      CASE WHEN c_custkey % 15 = 0 THEN CAST('NaN' AS DOUBLE) ELSE Latitude END AS Latitude FROM {site_base}"""


@query(
    "check_site_coordinates",
    "SELECT count(*) AS n_sites, count(*) FILTER (Longitude IS NULL OR isnan(Latitude)) AS missing_coordinates, count(*) - count(DISTINCT SSBS) AS repeated_sites, true AS crs_ok FROM {faulty_sites}",
)
def _(v):
    k = F.col("c_custkey")
    return c.check_site_coordinates(v("site_base").select(
        F.when(k % 7 == 0, "S0").otherwise(F.col("SSBS")).alias("SSBS"), F.when(k % 10 != 3, F.col("Longitude")).alias("Longitude"),
        F.when(k % 15 == 0, float("nan")).otherwise(F.col("Latitude")).alias("Latitude"),
    ))


PARTS["fold_rows"] = "SELECT SSBS, split_part(SSBS, '_', 1) AS SS, fold, CAST(l_partkey % 7 AS VARCHAR) AS taxon FROM {predictions}"


def _per_key(name: str, cols: str) -> str:
    return f"""SELECT f.fold, count(*) FILTER (nf > 1 OR NOT inf) AS train_{name}, count(*) FILTER (inf) AS test_{name},
        count(*) FILTER (inf AND nf > 1) AS overlap_{name}, count(*) FILTER (inf AND nf > 1) AS multi_fold_{name}
      FROM (SELECT DISTINCT fold FROM {{fold_rows}}) f JOIN LATERAL (
        SELECT {cols}, count(DISTINCT fold) AS nf, bool_or(r.fold = f.fold) AS inf FROM {{fold_rows}} r GROUP BY {cols}) k ON true GROUP BY f.fold"""


@query(
    "validate_folds",
    f"""SELECT s.*, t.* EXCLUDE (fold), k.* EXCLUDE (fold), d.* EXCLUDE (fold),
          test_studies / train_studies AS studies_ratio, test_sites / train_sites AS sites_ratio,
          test_observations / train_observations AS observations_ratio,
          NOT (overlap_check_keys > 0 OR multi_fold_check_keys > 0 OR overlap_studies > 0) AS leak_free,
          CAST(0 AS BIGINT) AS "null_SS", CAST(0 AS BIGINT) AS "null_SSBS", CAST(0 AS BIGINT) AS null_taxon,
          CAST(0 AS BIGINT) AS "empty_SS", CAST(0 AS BIGINT) AS "empty_SSBS", CAST(0 AS BIGINT) AS empty_taxon
        FROM ({_per_key('studies', 'SS')}) s JOIN ({_per_key('sites', 'SSBS')}) t ON s.fold = t.fold
        JOIN ({_per_key('check_keys', 'SSBS, taxon')}) k ON s.fold = k.fold
        JOIN (SELECT f.fold, CAST(sum(CASE WHEN tr > 1 THEN tr ELSE 0 END) AS BIGINT) AS duplicate_train_rows,
                CAST(sum(CASE WHEN te > 1 THEN te ELSE 0 END) AS BIGINT) AS duplicate_test_rows,
                CAST(sum(tr) AS BIGINT) AS train_observations, CAST(sum(te) AS BIGINT) AS test_observations
              FROM (SELECT DISTINCT fold FROM {{fold_rows}}) f JOIN LATERAL (
                SELECT count(*) FILTER (r.fold <> f.fold) AS tr, count(*) FILTER (r.fold = f.fold) AS te FROM {{fold_rows}} r GROUP BY SSBS, taxon) x ON true
              GROUP BY f.fold) d ON s.fold = d.fold""",
    "studies_ratio sites_ratio observations_ratio",
)
def _(v):
    from ecoframe.operators.folds import validate_folds

    df = v("predictions").select(
        "SSBS", F.split("SSBS", "_")[0].alias("SS"), F.col("fold").alias("Fold_id"),
        (F.col("l_partkey") % 7).cast("string").alias("taxon"),
    )
    return validate_folds(df, ["SSBS"], ["taxon"], 5)


@query("check_beta_scores", "SELECT count(*) FILTER (l_orderkey % 6 = 0 AND l_partkey % 4 <> 0) AS n_nan, count(*) FILTER (l_partkey % 4 = 0) AS n_null FROM {predictions}")
def _(v):
    score = F.when(F.col("l_partkey") % 4 == 0, None).when(F.col("l_orderkey") % 6 == 0, float("nan")).otherwise(F.col("Observed"))
    return c.check_beta_scores(v("predictions").select(score.alias("Bray_Curtis_score")))
