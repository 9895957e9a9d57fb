"""One-key grouped aggregates and cell density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import InvalidRequestError
from tessera.functions.boxes import BoundingBox
from tessera.functions.cells import cell_centre, cell_id, cell_text, check_resolution
from tessera.functions.paths import column_path, is_numeric, path_type

AGGREGATES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def within(df: DataFrame, box: BoundingBox | None, bbox: str = "bbox") -> DataFrame:
    return df if box is None else df.where(box.intersects(bbox))


def top(df: DataFrame, k: int | None, *order: Column) -> DataFrame:
    """The first k rows of a total order, or every row when k is None."""
    if k is None:
        return df
    if k < 1:
        raise InvalidRequestError(f"a row limit must be at least 1, got {k}")
    return df.orderBy(*order).limit(k)


def group_aggregate(
    df: DataFrame,
    group_by: str,
    aggregate: str = "count",
    measure: str | None = None,
    box: BoundingBox | None = None,
    k: int | None = None,
    bbox: str = "bbox",
) -> DataFrame:
    """``(group_value, value, row_count)`` per distinct value of a column.

    Spark combines each group inside the scan tasks before the shuffle, so a value that
    holds a large share of the rows arrives as one partial row per task.
    """
    path_type(df, group_by)
    if aggregate == "count":
        if measure is not None:
            raise InvalidRequestError("count counts rows and takes no measure column")
        value = F.count(F.lit(1))
    elif aggregate in AGGREGATES:
        if measure is None:
            raise InvalidRequestError(f"{aggregate} needs a measure column")
        measure_type = path_type(df, measure)
        if not is_numeric(measure_type):
            raise InvalidRequestError(
                f"{aggregate} needs a numeric measure; {measure} is {measure_type.simpleString()}"
            )
        value = AGGREGATES[aggregate](column_path(measure))
    else:
        raise InvalidRequestError(f"unknown aggregate {aggregate!r}: count, {', '.join(AGGREGATES)}")
    groups = (
        within(df, box, bbox)
        .groupBy(column_path(group_by).alias("group_value"))
        .agg(value.alias("value"), F.count(F.lit(1)).alias("row_count"))
    )
    return top(groups, k, F.col("value").desc_nulls_last(), F.col("group_value").asc_nulls_last())


def cell_density(
    df: DataFrame,
    box: BoundingBox | None = None,
    resolution: int = 8,
    grid: str = "quad",
    k: int | None = None,
    include_centre: bool = True,
    bbox: str = "bbox",
) -> DataFrame:
    """``(cell[, centre_lat, centre_lon], feature_count)``: features per grid cell.

    A feature belongs to the cell of its rectangle's centre, so only the four bbox
    members are read. The count is combined per task before it is shuffled by cell.
    """
    check_resolution(resolution)
    lon = (F.col(f"{bbox}.xmin") + F.col(f"{bbox}.xmax")) / F.lit(2.0)
    lat = (F.col(f"{bbox}.ymin") + F.col(f"{bbox}.ymax")) / F.lit(2.0)
    counts = (
        within(df, box, bbox)
        .groupBy(cell_id(lon, lat, resolution, grid).alias("id"))
        .agg(F.count(F.lit(1)).alias("feature_count"))
    )
    # The packed id orders like its text, so the top-k runs before any text is made.
    counts = top(counts, k, F.col("feature_count").desc(), F.col("id"))
    columns = [cell_text(F.col("id")).alias("cell")]
    if include_centre:
        lon_centre, lat_centre = cell_centre(F.col("id"), resolution, grid)
        columns += [lat_centre.alias("centre_lat"), lon_centre.alias("centre_lon")]
    return counts.select(*columns, "feature_count")
