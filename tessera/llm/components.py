"""Connected components of an edge table, by alternating large and small stars.

Every round is two grouped minima and two equi-joins, so a node with very many neighbours is
combined before the shuffle and split by the engine's skew handling after it. Each round is
written to the shared checkpoint folder: lost executors cost at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.staging import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point the larger (or the smaller) neighbours of every node at its least neighbour."""
    if large:
        around = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(F.col("u").alias("w"), "m")
    joined = around.join(least, F.col("u") == F.col("w"))
    moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else (
        joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    )
    return moved.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Columns ``node``, ``root`` for every node of an edge: the least node it can reach.

    ``edges`` has two columns of an orderable type; order, repetition and self-links do not
    matter. No edges give no rows.
    """
    first, second = edges.columns
    current = stage(
        edges.select(F.greatest(first, second).alias("u"), F.least(first, second).alias("v")).where("u != v").distinct(),
        "component-edges",
    )
    mark = None
    while True:
        row = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if row == mark or not row[0]:
            break
        mark = row
        current = stage(_star(_star(current, large=True), large=False), "component-edges")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
