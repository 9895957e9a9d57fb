"""The index of a literal shape against tests of all its edges."""

from __future__ import annotations

import math
import random
import time

import numpy as np
import pytest

from tessera.functions import geometry as geo
from tessera.functions.locator import Locator


def ring(rng, x, y, size, corners, digits=2):
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(corners))
    out = [(round(x + size * (r := rng.uniform(0.4, 1)) * math.cos(t), digits), round(y + size * r * math.sin(t), digits)) for t in turns]
    return "(" + ", ".join(f"{a} {b}" for a, b in [*out, out[0]]) + ")"


def shapes(rng):
    one = f"POLYGON ({ring(rng, 0, 0, 30, rng.randint(3, 60))})"
    holed = "POLYGON ((-20 -20, 20 -20, 20 20, -20 20, -20 -20), (-5 -5, 5 -5, 5 5, -5 5, -5 -5))"
    many = "MULTIPOLYGON (" + ", ".join(f"({ring(rng, rng.uniform(-40, 40), rng.uniform(-40, 40), rng.choice([1, 8]), rng.randint(3, 30))})" for _ in range(9)) + ")"
    overlapping = f"MULTIPOLYGON (({ring(rng, 0, 0, 12, 8)}), ({ring(rng, 2, 1, 12, 9)}), ((0 0, 6 0, 6 6, 0 0)))"
    line = "LINESTRING (-10 -10, 0 0, 10 0, 10 20)"
    mixed = f"GEOMETRYCOLLECTION (POINT (3 3), {line}, POLYGON ((20 20, 30 20, 30 30, 20 20)))"
    return [one, holed, many, overlapping, line, "POINT (1 1)", "MULTIPOINT (1 1, 2 2)", mixed, "POLYGON EMPTY"]


@pytest.mark.parametrize("seed", range(8))
def test_points(seed):
    rng = random.Random(seed)
    for wkt in shapes(rng):
        shape = geo.from_wkt(wkt)
        own = geo.vertices(shape)
        xy = np.array([(rng.uniform(-45, 45), rng.uniform(-45, 45)) for _ in range(400)] + [(x, y) for x in range(-20, 21, 5) for y in range(-20, 21, 5)] + own.tolist())
        middles = (own[1:] + own[:-1]) / 2 if len(own) > 1 else own
        xy = np.concatenate([xy, middles.reshape(-1, 2), [[np.nan, 1.0], [math.inf, 0.0]]])
        finite = np.isfinite(xy).all(axis=1)
        want = np.zeros(len(xy), bool)
        want[finite] = geo.touches_points(xy[finite], shape)
        assert (Locator(shape).touches(xy) == want).all(), wkt


@pytest.mark.parametrize("seed", range(8))
def test_other_geometries(seed):
    rng = random.Random(100 + seed)
    others = []
    for _ in range(25):
        x, y, size = rng.uniform(-35, 35), rng.uniform(-35, 35), rng.choice([0.01, 2, 10, 60])
        others += [f"POLYGON ({ring(rng, x, y, size, rng.randint(3, 12))})", f"LINESTRING ({x} {y}, {x + size} {y + size})", f"POINT ({x} {y})"]
    others += ["POLYGON ((-90 -90, 90 -90, 90 90, -90 90, -90 -90))", "POLYGON ((-4 -4, 4 -4, 4 4, -4 4, -4 -4))", "LINESTRING (20 -20, 20 20)", "POLYGON EMPTY",
               "POLYGON ((-90 -90, 90 -90, 90 90, -90 90, -90 -90), (-80 -80, 80 -80, 80 80, -80 80, -80 -80))"]
    for wkt in shapes(rng):
        shape = geo.from_wkt(wkt)
        index = Locator(shape)
        for other in map(geo.from_wkt, others):
            assert index.meets(other) == geo.intersects(other, shape), (wkt, other)


def test_time_does_not_grow_with_the_edges():
    rng = np.random.default_rng(3)
    xy = rng.uniform(-60, 60, (200_000, 2))

    def seconds(corners: int) -> float:
        turns = np.linspace(0, 2 * math.pi, corners, endpoint=False)
        reach = 40 + 10 * np.sin(9 * turns)
        points = np.column_stack([reach * np.cos(turns), reach * np.sin(turns)]).tolist()
        index = Locator(geo.from_wkt("POLYGON ((" + ", ".join(f"{a} {b}" for a, b in [*points, points[0]]) + "))"))
        start = time.process_time()
        index.touches(xy)
        return time.process_time() - start

    few, many = (min(seconds(corners) for _ in range(2)) for corners in (500, 20_000))
    assert many < 5 * few + 0.2
