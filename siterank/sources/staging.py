"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own_root: str | None = None


def stage_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a session in one process without one gets its own."""
    global _own_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="siterank-")
    return _own_root


def stage(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: later steps start from files, so a lost
    executor costs one task and not the whole lineage."""
    spark = df.sparkSession
    path = f"{stage_root(spark)}/siterank/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/siterank/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def drop_stages(spark: SparkSession) -> None:
    """Delete all staged tables of this application. To be called when its results are written: DataFrames that
    read staged tables cannot be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{stage_root(spark)}/siterank/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
