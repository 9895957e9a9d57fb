"""Rectangles in WGS 84 degrees and the prunable predicates they produce.

Every spatial question is first reduced to one or two rectangles, because four plain
comparisons on the members of a ``bbox`` struct are what the Parquet reader can check
against row-group statistics. Exact tests then run on the surviving rows only.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import InvalidRequestError

# Fixed value: mean Earth radius (IUGG), kilometres.
EARTH_RADIUS_KM = 6371.0088

# Room for rounding, in degrees, when a search circle is turned into a rectangle. The
# exact distance test runs afterwards, so a slightly larger rectangle costs nothing.
_BOX_SLACK_DEG = 1e-9


@dataclass(frozen=True)
class BoundingBox:
    """A closed rectangle. ``BoundingBox(...)`` insists on a positive area; the
    degenerate envelopes of points and axis-parallel lines come from `envelope`."""

    min_lon: float
    min_lat: float
    max_lon: float
    max_lat: float

    def __post_init__(self) -> None:
        for name, bound in (("lon", 180.0), ("lat", 90.0)):
            low, high = getattr(self, f"min_{name}"), getattr(self, f"max_{name}")
            for corner, value in ((f"min_{name}", low), (f"max_{name}", high)):
                if isinstance(value, bool) or not isinstance(value, (int, float)):
                    raise InvalidRequestError(f"{corner} must be a number, got {value!r}")
                if not -bound <= value <= bound:
                    raise InvalidRequestError(f"{corner}={value} is outside [-{bound:g}, {bound:g}]")
            if not self._ordered(low, high):
                raise InvalidRequestError(
                    f"min_{name} must be smaller than max_{name} (got {low} and {high}); a rectangle "
                    f"cannot cross the antimeridian, so ask for its two halves separately"
                )

    @staticmethod
    def _ordered(low: float, high: float) -> bool:
        return low < high

    @classmethod
    def envelope(cls, min_lon: float, min_lat: float, max_lon: float, max_lat: float) -> BoundingBox:
        return _Envelope(min_lon, min_lat, max_lon, max_lat)

    @classmethod
    def optional(cls, min_lon=None, min_lat=None, max_lon=None, max_lat=None) -> BoundingBox | None:
        """A rectangle from all four corners, None from no corner, else an error."""
        corners = {"min_lon": min_lon, "min_lat": min_lat, "max_lon": max_lon, "max_lat": max_lat}
        missing = [name for name, value in corners.items() if value is None]
        if len(missing) == 4:
            return None
        if missing:
            raise InvalidRequestError(
                f"a rectangle takes all four corners or none; missing: {', '.join(missing)}"
            )
        return cls(**corners)

    def as_dict(self) -> dict[str, float]:
        return {
            "min_lon": self.min_lon,
            "min_lat": self.min_lat,
            "max_lon": self.max_lon,
            "max_lat": self.max_lat,
        }

    def comparisons(self, column: str = "bbox") -> list[tuple[str, str, float]]:
        """The predicate as data: (column path, operator, value), all to hold."""
        return [
            (f"{column}.xmin", "<=", float(self.max_lon)),
            (f"{column}.xmax", ">=", float(self.min_lon)),
            (f"{column}.ymin", "<=", float(self.max_lat)),
            (f"{column}.ymax", ">=", float(self.min_lat)),
        ]

    def intersects(self, column: str = "bbox") -> Column:
        """Rows whose own rectangle touches this one, edges included."""
        return functools.reduce(
            operator.and_,
            (
                F.col(path) <= F.lit(value) if op == "<=" else F.col(path) >= F.lit(value)
                for path, op, value in self.comparisons(column)
            ),
        )


class _Envelope(BoundingBox):
    @staticmethod
    def _ordered(low: float, high: float) -> bool:
        return low <= high


def intersects_any(boxes: Sequence[BoundingBox], column: str = "bbox") -> Column:
    """Several rectangles in one scan; Spark pushes the whole disjunction down."""
    if not boxes:
        raise InvalidRequestError("at least one rectangle is needed")
    return functools.reduce(operator.or_, (box.intersects(column) for box in boxes))


def search_boxes(lon: float, lat: float, radius_km: float) -> list[BoundingBox]:
    """One or two rectangles that together cover a circle on the sphere.

    The half-width in longitude is asin(sin r / cos lat), reached on the two meridians
    that touch the circle. A circle over a pole needs every longitude, and one that
    crosses the antimeridian is cut into an eastern and a western rectangle.
    """
    if not -180.0 <= lon <= 180.0 or not -90.0 <= lat <= 90.0:
        raise InvalidRequestError(f"({lon}, {lat}) is not a longitude/latitude pair")
    angle = radius_km / EARTH_RADIUS_KM
    half_height = math.degrees(angle) + _BOX_SLACK_DEG
    south, north = max(-90.0, lat - half_height), min(90.0, lat + half_height)
    reach = math.sin(angle) / max(math.cos(math.radians(lat)), 1e-300)
    if north >= 90.0 or south <= -90.0 or reach >= 1.0 or angle >= math.pi / 2:
        return [BoundingBox(-180.0, south, 180.0, north)]
    half_width = math.degrees(math.asin(reach)) + _BOX_SLACK_DEG
    west, east = lon - half_width, lon + half_width
    if west < -180.0:
        return [
            BoundingBox(-180.0, south, east, north),
            BoundingBox.envelope(min(180.0, west + 360.0), south, 180.0, north),
        ]
    if east > 180.0:
        return [
            BoundingBox(west, south, 180.0, north),
            BoundingBox.envelope(-180.0, south, max(-180.0, east - 360.0), north),
        ]
    return [BoundingBox(west, south, east, north)]


def great_circle_km(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    """Haversine distance on the mean sphere, in kilometres."""
    half_dlat = F.radians(lat_b - lat_a) / F.lit(2.0)
    half_dlon = F.radians(lon_b - lon_a) / F.lit(2.0)
    chord = F.sin(half_dlat) * F.sin(half_dlat) + F.cos(F.radians(lat_a)) * F.cos(
        F.radians(lat_b)
    ) * F.sin(half_dlon) * F.sin(half_dlon)
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(chord)))
