from __future__ import annotations

import functools

from pyspark.sql import DataFrame, functions as F, types as T

from ecoframe.operators.ranking import dense_index
from ecoframe.session import scratch_path
from ecoframe.sources import tables
from registry.base import query

_INVENTORY = ["SS", "SSBS", "Taxon_name_entered", "Kingdom", "Sample_midpoint", "Measurement", "Longitude"]


@query("read_inventory_csv", f"SELECT {', '.join(_INVENTORY)} FROM {{site_obs}}", "Longitude")
def _(v):
    path = scratch_path(v.spark, "csv")
    df = v("site_obs").select(*_INVENTORY)
    df.write.option("header", True).option("nullValue", "NA").csv(path)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
    return tables.read_inventory_csv(v.spark, path, schema)


@query("read_columns", "SELECT l_orderkey, l_quantity FROM {lineitem}")
def _(v):
    return tables.read_columns(v.spark, f"{v.sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity"])


@query("write_table", "SELECT SSBS, Road_density_1km FROM {site_cov}", "Road_density_1km")
def _(v):
    path = scratch_path(v.spark, "table")
    tables.write_table(v("site_cov").select("SSBS", "Road_density_1km"), path)
    return v.spark.read.parquet(path)


@query("read_regional", "SELECT SSBS, Road_density_1km, Road_density_50km FROM {site_cov}", "Road_density_1km Road_density_50km")
def _(v):
    roads = v("site_cov").select("SSBS", "Road_density_1km", "Road_density_50km")
    paths = []
    for part in range(2):
        path = scratch_path(v.spark, f"region{part}")
        rows = roads.filter(F.pmod(F.xxhash64("SSBS"), F.lit(2)) == part)
        rows.withColumn("__index_level_0__", F.lit(part)).write.parquet(path)
        paths.append(path)
    return tables.read_regional(v.spark, paths)


@query(
    "read_predictions",
    "SELECT l_orderkey, SSBS, Observed, Predicted_FE, fold + 1 AS fold, 'test' AS mode FROM {predictions}",
    "Observed Predicted_FE",
)
def _(v):
    run = scratch_path(v.spark, "run")
    pred = v("predictions").select("l_orderkey", "SSBS", "Observed", "Predicted_FE", "fold")
    for k in range(5):
        out = f"{run}/key_output/test_predictions_fold_{k + 1}.parquet"
        pred.filter(F.col("fold") == k).drop("fold").write.parquet(out)
    return tables.read_predictions(v.spark, run, "Standard CV")


@query(
    "write_folds",
    "SELECT CAST(k AS INT) AS held_out, CASE WHEN fold = k THEN 'test' ELSE 'train' END AS side, l_orderkey, SSBS, Observed, fold AS Fold_id FROM {predictions}, range(5) r(k)",
    "Observed",
)
def _(v):
    path = scratch_path(v.spark, "folds")
    df = v("predictions").withColumnRenamed("fold", "Fold_id")
    tables.write_folds(df, path, ["l_orderkey", "SSBS", "Observed"])
    sides = [
        tables.read_folds(v.spark, path, k, side).select(F.lit(k).alias("held_out"), F.lit(side).alias("side"), "l_orderkey", "SSBS", "Observed", "Fold_id")
        for k in range(5) for side in ("train", "test")
    ]
    return functools.reduce(DataFrame.unionByName, sides)


@query(
    "write_mapping",
    "SELECT SS, CAST(dense_rank() OVER (ORDER BY SS) - 1 AS INT) AS idx FROM (SELECT DISTINCT SS FROM {site_obs}) t",
)
def _(v):
    path = scratch_path(v.spark, "mapping")
    mapping = dense_index(v("site_obs"), "SS")
    tables.write_mapping(mapping, path)
    return tables.read_mapping(v.spark, path, "SS string, idx int")


@query(
    "read_mapping",
    "SELECT Taxon_name_entered, CAST(dense_rank() OVER (ORDER BY Taxon_name_entered) - 1 AS INT) AS idx FROM (SELECT DISTINCT Taxon_name_entered FROM {site_obs}) t",
)
def _(v):
    path = scratch_path(v.spark, "taxa")
    tables.write_mapping(dense_index(v("site_obs"), "Taxon_name_entered"), path)
    return tables.read_mapping(v.spark, path, "Taxon_name_entered string, idx int")
