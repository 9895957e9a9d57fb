"""A footer table that is kept between queries and applications.

A store is a folder of versions, each a complete Parquet table of footer rows with the length and
modification time their file had. A call lists the files, which opens none, reads the footers of new
and changed ones, drops those of vanished ones, and writes the next version; if nothing has
changed, the last version is the answer as it is. A version is read only once Spark has
committed it, so a failed or concurrent writer leaves the last one in use.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.footers import SCHEMA, footers_of, listing

_STORED = f"{SCHEMA}, listed_bytes bigint, modified timestamp"
_VERSION = re.compile(r"version-(\d+)-[0-9a-f]+")


def _last_version(spark: SparkSession, store: str) -> tuple[int, str | None]:
    """Number and path of the newest committed version."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    best: tuple[int, str | None] = (0, None)
    if files.exists(path):
        for status in files.listStatus(path):
            match = _VERSION.fullmatch(status.getPath().getName())
            done = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
            if match and int(match[1]) > best[0] and files.exists(done):
                best = int(match[1]), status.getPath().toString()
    return best


def kept_footers(spark: SparkSession, store: str, *paths: str) -> DataFrame:
    """`footers` of the files under the paths, from the store where they are unchanged."""
    number, last = _last_version(spark, store)
    # The whole columns, so that no later read of the store goes through the listing again.
    now = listing(spark, *paths).select(
        F.col("path"), F.col("length"), F.col("length").alias("now_bytes"), F.col("modificationTime").alias("now_modified")
    )
    if last is None:
        held, fresh = None, now
    else:
        held = spark.read.schema(_STORED).parquet(last)
        known = held.select(F.col("file").alias("held_file"), "listed_bytes", "modified").distinct()
        same = (
            (F.col("path") == F.col("held_file"))
            & (F.col("now_bytes") == F.col("listed_bytes"))
            & (F.col("now_modified") == F.col("modified"))
        )
        compared = now.join(known, same, "full_outer")
        changes = compared.agg(F.count_if(F.col("held_file").isNull()).alias("fresh"), F.count_if(F.col("path").isNull()).alias("gone")).first()
        if not changes["fresh"] and not changes["gone"]:
            return held.drop("listed_bytes", "modified")
        fresh = now.join(known, same, "left_anti")
    read = footers_of(fresh)
    marks = fresh.select(F.col("path").alias("fresh_path"), F.col("now_bytes").alias("listed_bytes"), F.col("now_modified").alias("modified"))
    rows = read.join(marks, F.col("file") == F.col("fresh_path")).drop("fresh_path")
    if held is not None:
        still = now.select(F.col("path").alias("still_path"), "now_bytes", "now_modified")
        unchanged = (
            (F.col("file") == F.col("still_path"))
            & (F.col("listed_bytes") == F.col("now_bytes"))
            & (F.col("modified") == F.col("now_modified"))
        )
        rows = rows.unionByName(held.join(still, unchanged, "left_semi"))
    path = f"{store.rstrip('/')}/version-{number + 1}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(_STORED).parquet(path).drop("listed_bytes", "modified")
