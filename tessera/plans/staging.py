"""Intermediate tables in the cluster's shared checkpoint folder.

A staged table cuts lineage, survives the loss of executors, is read back with column
pruning, and has a measured size, so a later join can decide whether it may be
broadcast from a fact rather than from an estimate.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import StagingError


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting (tests) gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise StagingError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return spark.sparkContext.getCheckpointDir()


def _root(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/tessera-{spark.sparkContext.applicationId}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame once and return the table read back from disk."""
    spark = df.sparkSession
    path = f"{_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> bool:
    """Delete every table this application has staged; call it when no result derived
    from them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_root(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def measured(df: DataFrame, **aggregates) -> dict:
    """Named scalar aggregates of a DataFrame; the driver sees one row."""
    row = df.agg(*(expression.alias(name) for name, expression in aggregates.items())).first()
    return row.asDict()


def broadcast_if(df: DataFrame, size_bytes: int, limit_bytes: int) -> DataFrame:
    """A broadcast hint for a side whose measured size is within the limit."""
    return F.broadcast(df) if size_bytes <= limit_bytes else df
