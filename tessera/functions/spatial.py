"""Geometry columns: Arrow functions over well-known binary, and their SQL names."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import InvalidRequestError
from tessera.functions import geometry as geo
from tessera.functions.boxes import EARTH_RADIUS_KM, BoundingBox
from tessera.functions.locator import Locator

XY = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_XY_TYPE = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
_POINT_BYTES = 21
_POINT_HEAD = np.array([1, 1, 0, 0, 0], "u1")


def point_coordinates(wkb: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of a batch of WKB points (NaN where NULL, empty or not a point).

    Plain little-endian points are read as one strided view over the batch's buffer; only
    the other values are decoded one by one.
    """
    if isinstance(wkb, pa.ChunkedArray):
        wkb = wkb.combine_chunks()
    wkb = wkb.cast(pa.large_binary())
    x, y = np.full(len(wkb), np.nan), np.full(len(wkb), np.nan)
    if not len(wkb):
        return x, y
    offsets = np.frombuffer(wkb.buffers()[1], "i8")[wkb.offset : wkb.offset + len(wkb) + 1]
    valid = np.asarray(wkb.is_valid())
    plain = valid & (np.diff(offsets) == _POINT_BYTES)
    if plain.any():
        raw = np.frombuffer(wkb.buffers()[2], "u1")
        rows = raw[offsets[:-1][plain, None] + np.arange(_POINT_BYTES)]
        good = (rows[:, :5] == _POINT_HEAD).all(axis=1)
        plain[np.flatnonzero(plain)[~good]] = False
        xy = np.ascontiguousarray(rows[good, 5:]).view("<f8")
        x[plain], y[plain] = xy[:, 0], xy[:, 1]
    for i in np.flatnonzero(valid & ~plain):
        kind, xy = geo.from_wkb(wkb[int(i)].as_py())
        if kind == "Point" and len(xy):
            x[i], y[i] = xy[0]
    return x, y


def _doubles(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.float64(), mask=np.isnan(values))


@F.arrow_udf(_XY_TYPE)
def wkb_xy(wkb: pa.Array) -> pa.Array:
    x, y = point_coordinates(wkb)
    return pa.StructArray.from_arrays([_doubles(x), _doubles(y)], fields=list(XY))


# A filter on the coordinates would otherwise be pushed below the projection that holds
# them, and every geometry would be decoded twice.
wkb_xy = wkb_xy.asNondeterministic()


@F.arrow_udf(_XY_TYPE)
def points_only_xy(wkb: pa.Array) -> pa.Array:
    """As `wkb_xy`; a geometry that is not a point is an error rather than a row lost."""
    x, y = point_coordinates(wkb)
    for k in np.flatnonzero(np.isnan(x) & np.asarray(wkb.is_valid())):
        kind, _ = geo.from_wkb(wkb[int(k)].as_py())
        if kind != "Point":
            raise InvalidRequestError(f"this takes points, and the geometry of a row is a {kind}")
    return pa.StructArray.from_arrays([_doubles(x), _doubles(y)], fields=list(XY))


points_only_xy = points_only_xy.asNondeterministic()


@F.arrow_udf(T.DoubleType())
def st_x(wkb: pa.Array) -> pa.Array:
    return _doubles(point_coordinates(wkb)[0])


@F.arrow_udf(T.DoubleType())
def st_y(wkb: pa.Array) -> pa.Array:
    return _doubles(point_coordinates(wkb)[1])


def _each(wkb: pa.Array, function, data_type: pa.DataType) -> pa.Array:
    return pa.array(
        [None if value is None else function(geo.from_wkb(value)) for value in wkb.to_pylist()], data_type
    )


def _corner(index: int):
    @F.arrow_udf(T.DoubleType())
    def corner(wkb: pa.Array) -> pa.Array:
        return _each(wkb, lambda g: (geo.envelope(g) or (None,) * 4)[index], pa.float64())

    return corner


st_xmin, st_ymin, st_xmax, st_ymax = map(_corner, range(4))


@F.arrow_udf(T.StringType())
def st_asgeojson(wkb: pa.Array) -> pa.Array:
    return _each(wkb, geo.to_geojson, pa.string())


@F.arrow_udf(T.BinaryType())
def st_point(lon: pa.Array, lat: pa.Array) -> pa.Array:
    null = np.asarray(pc.or_(lon.is_null(), lat.is_null()))
    rows = np.empty((len(lon), _POINT_BYTES), "u1")
    rows[:, :5] = _POINT_HEAD
    xy = np.column_stack([np.asarray(c.cast(pa.float64()).fill_null(0.0)) for c in (lon, lat)])
    rows[:, 5:] = np.ascontiguousarray(xy, "<f8").view("u1")
    return pa.array([None if gone else row.tobytes() for gone, row in zip(null, rows)], pa.binary())


@F.arrow_udf(T.BinaryType())
def st_geomfromtext(text: pa.Array) -> pa.Array:
    return pa.array(
        [None if t is None else geo.to_wkb(geo.from_wkt(t)) for t in text.to_pylist()], pa.binary()
    )


def _pairwise(test):
    """A two-argument predicate; equal neighbouring values are decoded once."""

    def run(first: pa.Array, second: pa.Array) -> pa.Array:
        seen: list = [(None, None), (None, None)]

        def decode(side: int, value: bytes):
            if seen[side][0] != value:
                seen[side] = (value, geo.from_wkb(value))
            return seen[side][1]

        return pa.array(
            [
                None if a is None or b is None else test(decode(0, a), decode(1, b))
                for a, b in zip(first.to_pylist(), second.to_pylist())
            ],
            pa.bool_(),
        )

    return run


_contains, _intersects = _pairwise(geo.contains), _pairwise(geo.intersects)


@F.arrow_udf(T.BooleanType())
def st_contains(outer: pa.Array, inner: pa.Array) -> pa.Array:
    return _contains(outer, inner)


@F.arrow_udf(T.BooleanType())
def st_intersects(first: pa.Array, second: pa.Array) -> pa.Array:
    return _intersects(first, second)


@F.arrow_udf(T.DoubleType())
def st_distance_sphere(first: pa.Array, second: pa.Array) -> pa.Array:
    """Great-circle distance of two points, in metres."""
    (ax, ay), (bx, by) = (np.radians(point_coordinates(wkb)) for wkb in (first, second))
    chord = np.sin((by - ay) / 2) ** 2 + np.cos(ay) * np.cos(by) * np.sin((bx - ax) / 2) ** 2
    return _doubles(2000.0 * EARTH_RADIUS_KM * np.arcsin(np.minimum(1.0, np.sqrt(chord))))


# -- exact test against one literal shape ---------------------------------------------

class Shape:
    """A literal geometry: its envelope for pruning, and its exact test through an index of it."""

    def __init__(self, wkt: str):
        self.wkt = wkt
        self.geometry = geo.from_wkt(wkt)
        corners = geo.envelope(self.geometry)
        if corners is None:
            raise InvalidRequestError(f"{wkt[:80]!r} is an empty geometry and selects nothing")
        self.box = BoundingBox.envelope(*corners)

    def touches_point(self, x: Column, y: Column) -> Column:
        """Whether a point lies in or on the shape, tested per Arrow batch.

        Unrolling the edges into one SQL expression is slower already for ten of them.
        """
        wanted = Locator(self.geometry)

        @F.arrow_udf(T.BooleanType())
        def touches(px: pa.Array, py: pa.Array) -> pa.Array:
            xy = np.column_stack([np.asarray(c.cast(pa.float64()).fill_null(np.nan)) for c in (px, py)])
            return pa.array(wanted.touches(xy))

        return touches(x, y)

    def intersects_wkb(self, wkb: Column) -> Column:
        """Whether any kind of geometry shares a point with the shape."""
        wanted = Locator(self.geometry)

        @F.arrow_udf(T.BooleanType())
        def test(values: pa.Array) -> pa.Array:
            x, y = point_coordinates(values)
            hit = wanted.touches(np.column_stack([x, y]))
            valid = np.asarray(values.is_valid())
            for i in np.flatnonzero(valid & np.isnan(x)):
                hit[i] = wanted.meets(geo.from_wkb(values[int(i)].as_py()))
            return pa.array(hit, mask=~valid)

        return test(wkb)


# -- names for SQL --------------------------------------------------------------------


# The quad grid of `tessera.functions.cells` as SQL functions over built-in arithmetic: they
# are inlined at analysis, so a query using them stays in generated code.
_CELL_FUNCTIONS = {
    "cell_id": """(lon DOUBLE, lat DOUBLE, resolution INT) RETURNS STRING RETURN
        lpad(lower(hex(
            shiftleft(CAST(resolution AS BIGINT), 54)
            + shiftleft(least(floor((lon + 180D) / 360D
                * shiftleft(1L, CAST(round(4 + 1.4D * resolution) AS INT))),
                shiftleft(1L, CAST(round(4 + 1.4D * resolution) AS INT)) - 1), 27)
            + least(floor((lat + 90D) / 180D
                * shiftleft(1L, CAST(round(4 + 1.4D * resolution) AS INT))),
                shiftleft(1L, CAST(round(4 + 1.4D * resolution) AS INT)) - 1)
        )), 15, '0')""",
    "cell_lon": """(cell STRING) RETURNS DOUBLE RETURN
        (CAST(shiftright(CAST(conv(cell, 16, 10) AS BIGINT), 27) & 134217727 AS DOUBLE) + 0.5D)
        * (360D / shiftleft(1L, CAST(round(4 + 1.4D * shiftright(CAST(conv(cell, 16, 10) AS BIGINT), 54))
            AS INT))) - 180D""",
    "cell_lat": """(cell STRING) RETURNS DOUBLE RETURN
        (CAST(CAST(conv(cell, 16, 10) AS BIGINT) & 134217727 AS DOUBLE) + 0.5D)
        * (180D / shiftleft(1L, CAST(round(4 + 1.4D * shiftright(CAST(conv(cell, 16, 10) AS BIGINT), 54))
            AS INT))) - 90D""",
}

SQL_FUNCTIONS = {
    "st_x": st_x,
    "st_y": st_y,
    "st_xmin": st_xmin,
    "st_ymin": st_ymin,
    "st_xmax": st_xmax,
    "st_ymax": st_ymax,
    "st_point": st_point,
    "st_geomfromtext": st_geomfromtext,
    "st_asgeojson": st_asgeojson,
    "st_contains": st_contains,
    "st_intersects": st_intersects,
    "st_distance_sphere": st_distance_sphere,
}


def register_functions(spark: SparkSession) -> list[str]:
    """Make the spatial functions callable from SQL in this session.
    """
    for name, function in SQL_FUNCTIONS.items():
        spark.udf.register(name, function)
    for name, body in _CELL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return [*SQL_FUNCTIONS, *_CELL_FUNCTIONS]
