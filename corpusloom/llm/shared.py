"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Only where that is unset and the
    session is local, as in tests, a temporary folder takes its place."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="corpusloom-")
    return f"{base}/corpusloom-{uuid.uuid4().hex}"


def freed(spark: SparkSession) -> None:
    """Collect the driver's garbage once it fills half of the heap. Spark deletes shuffle
    files and broadcasts of finished jobs only when their objects are collected, which a
    driver with room to spare puts off."""
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if 2 * (heap.totalMemory() - heap.freeMemory()) > heap.maxMemory():
        gc.collect()
        spark._jvm.System.gc()


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The rows of `df`, written once and read back, which cuts the lineage: a
    lost executor costs a read, and no later job repeats the work."""
    path = f"{folder}/{name}"
    freed(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


LIMIT = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS = 256  # in an Arrow batch; texts can be long


def map_batches(df: DataFrame, work, schema) -> DataFrame:
    """df.mapInArrow(work, schema) with batches small enough for rows of long texts.
    The limit on batches belongs to the session, which keeps it."""
    conf = df.sparkSession.conf
    if int(conf.get(LIMIT)) > ROWS:
        conf.set(LIMIT, str(ROWS))
    return df.mapInArrow(work, schema)
