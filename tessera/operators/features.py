"""Feature selection by rectangle or shape, GeoJSON rows, preview."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import InvalidRequestError
from tessera.functions.boxes import BoundingBox, intersects_any
from tessera.functions.paths import attribute_filters, column_path, projection
from tessera.functions.spatial import Shape, st_asgeojson
from tessera.operators.aggregate import top

GEOMETRY = "__geometry"


def spatial_filter(
    df: DataFrame,
    box: BoundingBox | Sequence[BoundingBox] | None = None,
    wkt: str | None = None,
    *,
    category: str | None = None,
    name_contains: str | None = None,
    min_confidence: float | None = None,
    columns: Sequence[str] | None = None,
    include_geometry: bool = True,
    limit: int | None = None,
    order_by: Sequence[str] = (),
    bbox: str = "bbox",
    geometry: str | None = "geometry",
    default_columns: Sequence[str] = (),
    category_column: str | None = None,
    name_column: str | None = None,
    confidence_column: str | None = None,
) -> DataFrame:
    """Features touching a rectangle (or any of several) or a WKT shape.

    The result has the selected columns and ``__geometry``, a GeoJSON text. A shape
    prunes by its envelope and is then tested exactly on the rows left. Without
    `include_geometry` the geometry column is not read and the feature is placed at its
    rectangle's corner, which is exact for points; a shape test needs the geometry, so
    it keeps it. Pass ``geometry=None`` for point tables whose bbox is the geometry.
    """
    if (box is None) == (wkt is None):
        raise InvalidRequestError("give exactly one of a rectangle (all four corners) and a WKT shape")
    if wkt is not None:
        shape = Shape(wkt)
        pruned = df.where(shape.box.intersects(bbox))
        exact = (
            shape.intersects_wkb(F.col(geometry))
            if geometry
            else shape.touches_point(F.col(f"{bbox}.xmin"), F.col(f"{bbox}.ymin"))
        )
    else:
        boxes = [box] if isinstance(box, BoundingBox) else list(box)
        pruned, exact = df.where(intersects_any(boxes, bbox)), None
    for condition in attribute_filters(
        category,
        name_contains,
        min_confidence,
        category_column=category_column,
        name_column=name_column,
        confidence_column=confidence_column,
    ):
        pruned = pruned.where(condition)
    if exact is not None:
        pruned = pruned.where(exact)
    if limit is not None and order_by:
        pruned = top(pruned, limit, *(F.col(c).asc_nulls_last() for c in order_by))
    use_geometry = geometry is not None and (include_geometry or wkt is not None)
    placed = st_asgeojson(F.col(geometry)) if use_geometry else corner_geojson(bbox)
    chosen = pruned.select(*projection(pruned, columns, default_columns), placed.alias(GEOMETRY))
    # As the last step a plain limit stops the scan after the first partitions that fill it.
    return chosen if limit is None or order_by else chosen.limit(_positive(limit))


def bbox_filter(df: DataFrame, box: BoundingBox, **options) -> DataFrame:
    """`spatial_filter` with a rectangle."""
    return spatial_filter(df, box=box, **options)


def _positive(limit: int) -> int:
    if limit < 1:
        raise InvalidRequestError(f"a row limit must be at least 1, got {limit}")
    return limit


def corner_geojson(bbox: str = "bbox") -> Column:
    """A GeoJSON point at the south-west corner of the feature's rectangle."""
    return F.to_json(
        F.struct(
            F.lit("Point").alias("type"),
            F.array(F.col(f"{bbox}.xmin"), F.col(f"{bbox}.ymin")).alias("coordinates"),
        )
    )


def to_features(features: DataFrame) -> DataFrame:
    """One GeoJSON Feature text per row, in a column ``feature``.

    Every column but the geometry becomes a property (NULL stays, as JSON null), and
    ``id`` is also the feature's id. Write it with ``df.write.text`` for a
    newline-delimited file.
    """
    properties = [
        F.col(f"`{f.name}`").alias(f.name) for f in features.schema if f.name != GEOMETRY
    ]
    keep_nulls = {"ignoreNullFields": "false"}
    parts = [
        F.lit('{"type":"Feature","geometry":'),
        F.coalesce(F.col(GEOMETRY), F.lit("null")),
        F.lit(',"properties":'),
        F.to_json(F.struct(*properties), keep_nulls) if properties else F.lit("{}"),
    ]
    if "id" in features.columns:
        # A one-field object without its braces: Spark's own quoting of the value.
        as_object = F.to_json(F.struct(F.col("id").alias("id")), keep_nulls)
        parts += [F.lit(","), F.substring(as_object, F.lit(2), F.length(as_object) - 2)]
    return features.select(F.concat(*parts, F.lit("}")).alias("feature"))


def preview(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    n: int = 10,
    default_columns: Sequence[str] = (),
) -> DataFrame:
    """The first n rows in file order.

    The given DataFrame is read, with whatever filters and projections it has. Of a bare
    scan only as many leading files as hold n rows are read. A DataFrame without file
    positions has no file order, and its first n rows are whatever Spark produces first.
    """
    if n < 1:
        raise InvalidRequestError(f"a preview holds at least one row, got {n}")
    chosen = projection(df, columns, default_columns)
    if not _has_positions(df):
        return df.select(*chosen).limit(n)
    position = [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    last = _last_file_needed(df, n) if _is_bare_scan(df) else None
    head = df if last is None else df.where(position[0] <= last)
    placed = head.select(*chosen, *(p.alias(f"__at{k}") for k, p in enumerate(position)))
    return placed.orderBy("__at0", "__at1").limit(n).drop("__at0", "__at1")


def _has_positions(df: DataFrame) -> bool:
    try:
        return df.select("_metadata.row_index").schema[0].dataType == T.LongType()
    except Exception:  # no such hidden column: not from files
        return False


def _is_bare_scan(df: DataFrame) -> bool:
    return df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"


def _last_file_needed(df: DataFrame, n: int) -> str | None:
    """The file that holds the n-th row, from row counts (no column is read) of the first files; None
    if those hold fewer."""
    files = sorted(df.inputFiles())[:n]
    first = df.where(F.col("_metadata.file_path") <= files[-1]) if files else df.limit(0)
    held = 0
    for row in first.groupBy(F.col("_metadata.file_path").alias("file")).count().orderBy("file").collect():
        held += row["count"]
        if held >= n:
            return row["file"]
    return None


def with_file_name(df: DataFrame, name: str = "filename") -> DataFrame:
    """Every row with the path of the file it was read from."""
    return df.select("*", F.col("_metadata.file_path").alias(name))


def extent_by_scan(df: DataFrame, bbox: str = "bbox") -> DataFrame:
    """The rectangle around every feature and the rows examined; reads only the bbox."""
    return df.agg(
        F.min(f"{bbox}.xmin").alias("min_lon"),
        F.min(f"{bbox}.ymin").alias("min_lat"),
        F.max(f"{bbox}.xmax").alias("max_lon"),
        F.max(f"{bbox}.ymax").alias("max_lat"),
        F.count(F.lit(1)).alias("rows_examined"),
    )


def busiest_file(df: DataFrame, box: BoundingBox, bbox: str = "bbox") -> DataFrame:
    """The file holding the most features that touch a rectangle."""
    return top(
        df.where(box.intersects(bbox))
        .groupBy(F.col("_metadata.file_path").alias("filename"))
        .agg(F.count(F.lit(1)).alias("matches")),
        1,
        F.col("matches").desc(),
        F.col("filename"),
    )


def forced_read(df: DataFrame, box: BoundingBox, name_path: str, bbox: str = "bbox") -> DataFrame:
    """Match count and longest name: an aggregate that cannot be answered from footers."""
    return df.where(box.intersects(bbox)).agg(
        F.count(F.lit(1)).alias("matches"),
        F.max(F.length(column_path(name_path))).cast("bigint").alias("longest_name"),
    )
