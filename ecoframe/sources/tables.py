"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ecoframe.functions.nulls import col

def read_inventory_csv(
    spark: SparkSession, paths: str | list[str], schema: T.StructType | None = None
) -> DataFrame:
    """Header CSV with ``NA`` as the null marker.

    Give a schema where possible. Without one, types come from a pass over all rows of all files,
    so no value is lost to a type that only the first rows had. A row that does not fit the
    schema is an error, not a null.
    """
    reader = spark.read.option("header", True).option("nullValue", "NA")
    if schema is None:
        schema = reader.option("inferSchema", True).option("samplingRatio", 1.0).csv(paths).schema
        reader = spark.read.option("header", True).option("nullValue", "NA")
    return reader.schema(schema).option("mode", "FAILFAST").csv(paths)


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Parquet scan of the named columns only."""
    return spark.read.parquet(path).select(*[col(c) for c in columns])


def write_table(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Parquet; an empty frame is refused, and so is an existing path unless told otherwise."""
    if df.isEmpty():
        raise ValueError(f"Refusing to write an empty table to {path}")
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def read_regional(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One table per region, stacked, without the index artefact."""
    return spark.read.option("mergeSchema", True).parquet(*paths).drop("__index_level_0__")


def read_predictions(spark: SparkSession, run_dir: str, mode: str) -> DataFrame:
    """Predictions of a run: the training file, or all test folds with their fold number."""
    folder = f"{run_dir.rstrip('/')}/key_output"
    if "training" in mode.lower():
        return spark.read.parquet(f"{folder}/train_predictions.parquet").withColumn("mode", F.lit("Training"))
    fold = F.regexp_extract(F.col("_metadata.file_path"), r"test_predictions_fold_(\d+)", 1)
    return (
        spark.read.parquet(f"{folder}/test_predictions_fold_*.parquet")
        .select("*", fold.cast("int").alias("fold"), F.lit("test").alias("mode"))
    )


def write_folds(df: DataFrame, path: str, columns: list[str]) -> None:
    """One table partitioned by fold; a training set is "every other partition"."""
    out = df.select(*[col(c) for c in columns], "Fold_id")
    if out.isEmpty():
        raise ValueError(f"Refusing to write an empty table to {path}")
    # Every task writes its rows of each fold (k files); folds are never gathered in one task.
    out.write.mode("errorifexists").partitionBy("Fold_id").parquet(path)


def read_folds(spark: SparkSession, path: str, fold: int, role: str) -> DataFrame:
    df = spark.read.parquet(path)
    if role not in ("train", "test"):
        raise ValueError(f"Unsupported role: {role}")
    return df.filter(F.col("Fold_id") == fold if role == "test" else F.col("Fold_id") != fold)


def write_mapping(df: DataFrame, path: str) -> None:
    """Small mapping tables as JSON lines."""
    df.write.mode("errorifexists").json(path)


def read_mapping(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)
