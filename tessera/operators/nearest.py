"""The k nearest features within a radius."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import InvalidRequestError
from tessera.functions.boxes import great_circle_km, intersects_any, search_boxes
from tessera.functions.paths import attribute_filters, projection
from tessera.functions.spatial import points_only_xy
from tessera.operators.aggregate import top

MAX_RADIUS_KM = 500.0


def nearest(
    df: DataFrame,
    lon: float,
    lat: float,
    radius_km: float = 1.0,
    *,
    category: str | None = None,
    name_contains: str | None = None,
    min_confidence: float | None = None,
    columns: Sequence[str] | None = None,
    k: int | None = None,
    tie_break: Sequence[str] = ("id",),
    bbox: str = "bbox",
    geometry: str | None = "geometry",
    default_columns: Sequence[str] = (),
    category_column: str | None = None,
    name_column: str | None = None,
    confidence_column: str | None = None,
) -> DataFrame:
    """Features within `radius_km` of a point, closest first, with ``distance_km``.

    The circle's rectangle prunes row groups; the great-circle distance is computed on
    the rows left, rounded to 4 decimals, and both filters and ranks. Coordinates come
    from the geometry column, which must hold points; ``geometry=None`` takes them from the bbox instead, which
    is exact when its members are doubles and every feature is a point. Ranking is a
    per-task top k merged on the driver side of the plan, never a full sort.
    """
    if not 0.0 < radius_km <= MAX_RADIUS_KM:
        raise InvalidRequestError(f"radius_km={radius_km} is outside (0, {MAX_RADIUS_KM:g}]")
    near = df.where(intersects_any(search_boxes(lon, lat, radius_km), bbox))
    for condition in attribute_filters(
        category,
        name_contains,
        min_confidence,
        category_column=category_column,
        name_column=name_column,
        confidence_column=confidence_column,
    ):
        near = near.where(condition)
    if geometry:
        near = near.withColumn("__xy", points_only_xy(F.col(geometry)))
        x, y = F.col("__xy.x"), F.col("__xy.y")
    else:
        x, y = F.col(f"{bbox}.xmin"), F.col(f"{bbox}.ymin")
    distance = F.round(great_circle_km(x, y, F.lit(float(lon)), F.lit(float(lat))), 4)
    near = near.withColumn("distance_km", distance).where(F.col("distance_km") <= F.lit(float(radius_km)))
    ties = [F.col(c).asc_nulls_last() for c in tie_break if c in df.columns]
    ranked = top(near, k, F.col("distance_km"), *ties)
    return ranked.select(*projection(df, columns, default_columns), "distance_km")
