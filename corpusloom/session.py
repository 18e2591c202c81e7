"""Session helpers for local runs; on a cluster the submitted session is used as is."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "corpusloom", cpus: str | int = "*") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """A table. With `spread`, for work that is heavy per row, a table whose
    files give fewer scan tasks than there are cores is dealt out to all of
    them; one with many files is read as it is, without a shuffle."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def new_folder(spark: SparkSession) -> str:
    """A new folder in the one that spark.checkpoint.dir names and all executors share. Only
    where that is unset and the session is local, as in tests, a temporary folder is used."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="corpusloom-")
    return f"{base}/tables-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """The rows of `df`, computed once and kept in the shared folder that
    spark.checkpoint.dir names, so that lost executors cost nothing. Only where
    that is unset, as in tests, a temporary folder is used."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="corpusloom-"))
    return df.checkpoint()
