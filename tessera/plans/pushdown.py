"""What predicate pushdown saves: the same query with and without it."""

from __future__ import annotations

import re
import time
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

from tessera.errors import InvalidRequestError
from tessera.functions.boxes import BoundingBox
from tessera.operators.features import busiest_file, forced_read
from tessera.sources.footers import footers, footprint, scan_report

_SETTING = "spark.sql.parquet.filterPushdown"


@contextmanager
def _pushdown(spark: SparkSession, enabled: bool):
    before = spark.conf.get(_SETTING)
    spark.conf.set(_SETTING, str(enabled).lower())
    try:
        yield
    finally:
        spark.conf.set(_SETTING, before)


def _timed(spark: SparkSession, make, enabled: bool) -> dict:
    """Matches, seconds and the rows the scan produced."""
    with _pushdown(spark, enabled):
        df = make()
        start = time.perf_counter()
        matches = df.collect()[0]["matches"]
        seconds = time.perf_counter() - start
        plan = df._jdf.queryExecution().executedPlan()
        if "Adaptive" in plan.getClass().getSimpleName():
            plan = plan.executedPlan()
        rows = _scan_rows(plan)
    return {"matches": matches, "seconds": round(seconds, 4), "rows": rows}


def _scan_rows(plan) -> int:
    """Rows the scans of an executed plan produced; finished stages are looked into."""
    rows = 0
    leaves = plan.collectLeaves().iterator()
    while leaves.hasNext():
        leaf = leaves.next()
        kind = leaf.getClass().getSimpleName()
        if "QueryStage" in kind:
            rows += _scan_rows(leaf.plan())
        elif kind == "FileSourceScanExec":
            rows += leaf.metrics().get("numOutputRows").get().value()
    return rows


def path_of(url: str) -> str:
    """A file's URL, as Spark reports it, as a path to read: decoded, and with no sign taken for a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(url))


def pushdown_report(
    spark: SparkSession,
    path: str,
    box: BoundingBox,
    name_path: str = "names.primary",
    mode: str = "single_file",
    bbox: str = "bbox",
) -> DataFrame:
    """One row comparing a rectangle query with pushdown on and off.

    ``single_file`` uses the file with the most matches on both sides; ``whole_dataset``
    runs the pushed side over all files and compares with their total size. Bytes are
    footer arithmetic over the columns read, and the footers, which both sides need, are
    counted apart.
    """
    if mode not in ("single_file", "whole_dataset"):
        raise InvalidRequestError(f"mode must be 'single_file' or 'whole_dataset', got {mode!r}")
    target = path
    if mode == "single_file":
        busiest = busiest_file(spark.read.parquet(path), box, bbox).first()
        if busiest is None:
            raise InvalidRequestError("no feature touches this rectangle; widen it")
        target = path_of(busiest["filename"])
    table = footers(spark, target)
    cost = scan_report(table, [name_path], box, bbox).first()
    size = footprint(table).first()

    def query() -> DataFrame:
        return forced_read(spark.read.parquet(target), box, name_path, bbox)

    on = _timed(spark, query, True)
    off = _timed(spark, query, False) if mode == "single_file" else None
    row = {
        "mode": mode,
        "target": target,
        "matches": on["matches"],
        "target_bytes": size["bytes"],
        "footer_bytes": size["footer_bytes"],
        "bytes_with_pushdown": cost["bytes_scanned"],
        "bytes_without_pushdown": cost["bytes_unpruned"] if off else None,
        "pushdown_ratio": cost["pruning_ratio"] if off else None,
        "download_avoided_ratio": round(size["bytes"] / cost["bytes_scanned"], 1) if cost["bytes_scanned"] else None,
        "scan_rows_with_pushdown": on["rows"],
        "scan_rows_without_pushdown": off["rows"] if off else None,
        "seconds_with_pushdown": on["seconds"],
        "seconds_without_pushdown": off["seconds"] if off else None,
    }
    schema = (
        "mode string, target string, matches bigint, target_bytes bigint, footer_bytes bigint, "
        "bytes_with_pushdown bigint, bytes_without_pushdown bigint, pushdown_ratio double, "
        "download_avoided_ratio double, scan_rows_with_pushdown bigint, scan_rows_without_pushdown bigint, "
        "seconds_with_pushdown double, seconds_without_pushdown double"
    )
    return spark.createDataFrame([tuple(row.values())], schema)


