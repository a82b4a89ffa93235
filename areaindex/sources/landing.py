"""Shared scratch space: intermediate tables that must survive the loss of executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The library's folder under ``spark.checkpoint.dir``, or under the warehouse where that is unset; all
    executors share either.  Nothing is written to the session's settings."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/areaindex"


def _root(spark: SparkSession) -> str:
    """This application's folder."""
    return f"{shared_root(spark)}/{spark.sparkContext.applicationId}"


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path under this application's folder."""
    return f"{_root(spark)}/{name}-{uuid.uuid4().hex}"


def land(df: DataFrame, name: str = "table", dictionary: bool = True) -> DataFrame:
    """Write the frame and read it back: lineage is cut, later stages read it once computed, and
    Catalyst plans joins on its true size.  Without ``dictionary`` the columns are written plainly: for many
    columns of measures, which hardly repeat, that takes half the time and up to twice the disk."""
    path = scratch_dir(df.sparkSession, name)
    df.write.option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_landed(spark: SparkSession) -> None:
    """Remove what this application has landed.  Call it when results are written: frames that read
    landed tables are of no use afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
