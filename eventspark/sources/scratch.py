"""Scratch tables in the cluster's shared folder: lineage is cut there, rows are fixed, lost executors cost a stage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``.

    The setting is read from the session. Where it is unset in local mode (tests) a temporary folder becomes the
    checkpoint folder; on a cluster that is an error, as executors don't share such a folder. The folder is named after
    the application, so a cluster can purge it.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="eventspark-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/eventspark-{sc.applicationId}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut, rows are fixed."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` made and that no frame still in use reads."""
    for df in tables:
        delete(df.sparkSession, df.__dict__.pop("scratch_path"))


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def purge_scratch(spark: SparkSession) -> None:
    """Delete every table that ``materialize`` wrote in this application. Frames built on them end with it."""
    delete(spark, scratch_root(spark))
