"""Session settings and the shared scratch area used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "ecoframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator is written for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Split a hot key even where an aggregate on the same key follows the join.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        # Call-site capture costs several round trips to the JVM per column expression, which
        # dominates the time to build wide plans.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder shared by all executors; the cluster names it in ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        # A folder of one machine would be another folder on every executor.
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors share")
    # Nothing configured: a single-machine test session.
    local = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the scratch root, removed when the session ends."""
    path = f"{scratch_root(spark).rstrip('/')}/ecoframe-{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared scratch area and read it back.

    Used where two later steps must see the very same rows and row placement (for example
    positions after a range sort). The written table survives the loss of executors, has exact
    size statistics for the optimizer and allows column pruning. It stays until the session ends or
    :func:`release` is called on the returned frame, when nothing made from it is needed any more.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    stage = spark.read.schema(df.schema).parquet(path)
    _stages[id(stage)] = (weakref.ref(stage), path)
    return stage


_stages: dict[int, tuple[weakref.ref, str]] = {}


def release(stage: DataFrame) -> None:
    """Delete the table behind a frame from :func:`materialise`; its readers must have finished."""
    kept, path = _stages.pop(id(stage), (None, ""))
    if kept is None or kept() is not stage:
        raise ValueError("Not a materialised frame, or released before")
    spark = stage.sparkSession
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)
