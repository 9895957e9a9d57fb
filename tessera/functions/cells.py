"""Cell grids: a point to a 64-bit cell, a cell to its centre, both as plain Columns.

``quad``  halves longitude and latitude ``round(4 + 1.4 * resolution)`` times. Cells nest
          strictly, so a finer resolution only splits them.
``hex``   hexagons on the Lambert cylindrical equal-area plane, edge 1100 km / sqrt(7)^res.
          Cells of one resolution have equal area; they do not nest.

The ids are this package's own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import InvalidRequestError
from tessera.functions.boxes import EARTH_RADIUS_KM

GRIDS = ("quad", "hex")
MIN_RESOLUTION, MAX_RESOLUTION = 0, 15

# id = resolution << 54 | x << 27 | y; hexagon coordinates are shifted to be positive.
_AXIS_BITS = 27
_AXIS_MASK = (1 << _AXIS_BITS) - 1
_HEX_SHIFT = 1 << (_AXIS_BITS - 1)
_HEX_EDGE_KM = 1100.0


def check_resolution(resolution: int) -> int:
    if isinstance(resolution, bool) or not isinstance(resolution, int):
        raise InvalidRequestError(f"resolution must be a whole number, got {resolution!r}")
    if not MIN_RESOLUTION <= resolution <= MAX_RESOLUTION:
        raise InvalidRequestError(
            f"resolution {resolution} is outside [{MIN_RESOLUTION}, {MAX_RESOLUTION}]"
        )
    return resolution


def quad_level(resolution: int) -> int:
    return round(4 + 1.4 * resolution)


def hex_edge_km(resolution: int) -> float:
    return _HEX_EDGE_KM / math.sqrt(7.0) ** resolution


def _pack(resolution: int, x: Column, y: Column) -> Column:
    return (
        F.lit(resolution << (2 * _AXIS_BITS)).cast("bigint")
        + F.shiftleft(x.cast("bigint"), _AXIS_BITS)
        + y.cast("bigint")
    )


def _unpack(cell: Column) -> tuple[Column, Column]:
    mask = F.lit(_AXIS_MASK).cast("bigint")
    return F.shiftright(cell, _AXIS_BITS).bitwiseAND(mask), cell.bitwiseAND(mask)


def _quad_cell(lon: Column, lat: Column, resolution: int) -> Column:
    n = float(1 << quad_level(resolution))
    x = F.least(F.floor((lon + F.lit(180.0)) / F.lit(360.0) * F.lit(n)), F.lit(int(n) - 1))
    y = F.least(F.floor((lat + F.lit(90.0)) / F.lit(180.0) * F.lit(n)), F.lit(int(n) - 1))
    return _pack(resolution, x, y)


def _quad_centre(cell: Column, resolution: int) -> tuple[Column, Column]:
    n = float(1 << quad_level(resolution))
    x, y = _unpack(cell)
    lon = (x.cast("double") + F.lit(0.5)) * F.lit(360.0 / n) - F.lit(180.0)
    lat = (y.cast("double") + F.lit(0.5)) * F.lit(180.0 / n) - F.lit(90.0)
    return lon, lat


def _hex_cell(lon: Column, lat: Column, resolution: int) -> Column:
    edge = hex_edge_km(resolution)
    x = F.radians(lon) * F.lit(EARTH_RADIUS_KM)
    y = F.sin(F.radians(lat)) * F.lit(EARTH_RADIUS_KM)
    q = x * F.lit(2.0 / 3.0) / F.lit(edge)
    r = (y * F.lit(math.sqrt(3.0) / 3.0) - x / F.lit(3.0)) / F.lit(edge)
    s = -q - r

    def near(value: Column) -> Column:
        return F.floor(value + F.lit(0.5)).cast("double")

    # Cube rounding: the coordinate rounded furthest is rebuilt from the other two.
    dq, dr, ds = F.abs(near(q) - q), F.abs(near(r) - r), F.abs(near(s) - s)
    q_cell = F.when((dq > dr) & (dq > ds), -near(r) - near(s)).otherwise(near(q))
    r_cell = F.when((dq > dr) & (dq > ds), near(r)).otherwise(
        F.when(dr > ds, -near(q) - near(s)).otherwise(near(r))
    )
    return _pack(resolution, q_cell + F.lit(_HEX_SHIFT), r_cell + F.lit(_HEX_SHIFT))


def _hex_centre(cell: Column, resolution: int) -> tuple[Column, Column]:
    edge = hex_edge_km(resolution)
    q, r = (axis.cast("double") - F.lit(float(_HEX_SHIFT)) for axis in _unpack(cell))
    x = F.lit(1.5 * edge) * q
    y = F.lit(math.sqrt(3.0) * edge) * (r + q / F.lit(2.0))
    sine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), y / F.lit(EARTH_RADIUS_KM)))
    return F.degrees(x / F.lit(EARTH_RADIUS_KM)), F.degrees(F.asin(sine))


def cell_id(lon: Column, lat: Column, resolution: int, grid: str = "quad") -> Column:
    """The cell holding a point, as a bigint."""
    check_resolution(resolution)
    if grid == "quad":
        return _quad_cell(lon, lat, resolution)
    if grid == "hex":
        return _hex_cell(lon, lat, resolution)
    raise InvalidRequestError(f"unknown grid {grid!r}; choose one of {', '.join(GRIDS)}")


def cell_centre(cell: Column, resolution: int, grid: str = "quad") -> tuple[Column, Column]:
    """(longitude, latitude) of a cell's centre."""
    if grid == "quad":
        return _quad_centre(cell, resolution)
    if grid == "hex":
        return _hex_centre(cell, resolution)
    raise InvalidRequestError(f"unknown grid {grid!r}; choose one of {', '.join(GRIDS)}")


def cell_text(cell: Column) -> Column:
    return F.lpad(F.lower(F.hex(cell)), 15, "0")
