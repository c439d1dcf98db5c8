"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode a temporary folder where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quarrystone-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again: computed once, whatever reads it, with real sizes for the planner. The files go when the driver's JVM ends."""
    return written_in_turn([df], name)


def written_in_turn(dfs: Sequence[DataFrame], name: str, by: Sequence[str] = ()) -> DataFrame:
    """written() of the rows of all dfs, which have one schema; each is done before the next one begins. Values of ``by`` have folders of their own, so that a filter on them reads no other rows."""
    spark = dfs[0].sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for df in dfs:
        df.write.mode("append").partitionBy(*by).parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(at)
    return spark.read.schema(dfs[0].schema).parquet(path)


def bucketed(df: DataFrame, name: str, buckets: int, by: Sequence[str], sort: Sequence[str], table: str | None = None) -> DataFrame:
    """df as a table in the shared folder with one sorted file a bucket, read again: joins and groups on ``by`` need no shuffle of it.

    With the name of a table it is saved under that name in the session's catalog and stays; else its files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    own = f"{name}_{uuid.uuid4().hex}"
    saved, path = table or own, f"{shared_folder(spark)}/{own}"
    df.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*sort).option("path", path).saveAsTable(saved)
    if not table:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(at)
    return spark.table(saved)
