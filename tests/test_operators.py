"""Operators against brute force, beyond what the corpus covers."""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.errors import InvalidRequestError, StatisticsMissingError
from tessera.functions import geometry as geo
from tessera.functions import tiles
from tessera.functions.boxes import EARTH_RADIUS_KM, BoundingBox, intersects_any, search_boxes
from tessera.functions.cells import cell_centre, cell_id
from tessera.functions.spatial import Shape, st_point
from tessera.operators import aggregate, containment, features, nearest, statistics
from tessera.sources import footers
from tessera.sources.catalog import with_bbox


def haversine(lon_a, lat_a, lon_b, lat_b):
    lon_a, lat_a, lon_b, lat_b = map(np.radians, (lon_a, lat_a, lon_b, lat_b))
    chord = np.sin((lat_b - lat_a) / 2) ** 2 + np.cos(lat_a) * np.cos(lat_b) * np.sin((lon_b - lon_a) / 2) ** 2
    return 2 * EARTH_RADIUS_KM * np.arcsin(np.minimum(1, np.sqrt(chord)))


def star(rng, cx, cy, radius, n, digits=None):
    angle = np.sort(rng.uniform(0, 2 * np.pi, n))
    reach = radius * rng.uniform(0.3, 1, n)
    ring = np.column_stack([cx + reach * np.cos(angle), cy + reach * np.sin(angle)])
    ring = ring if digits is None else np.round(ring, digits)
    return np.vstack([ring, ring[:1]])


def polygon_rows(named):
    rows = []
    for name, subtype, rings in named:
        geometry = ("Polygon", rings)
        x0, y0, x1, y1 = geo.envelope(geometry)
        rows.append(((name,), subtype, (x0, x1, y0, y1), bytearray(geo.to_wkb(geometry))))
    return rows


POLYGON_SCHEMA = (
    "names struct<primary:string>, subtype string, "
    "bbox struct<xmin:double,xmax:double,ymin:double,ymax:double>, geometry binary"
)


def point_frame(spark, x, y):
    frame = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "lon": x, "lat": y}))
    return with_bbox(frame)


# -- rectangles and distances ---------------------------------------------------------


def test_search_boxes_hold_the_circle():
    rng = np.random.default_rng(3)
    for _ in range(300):
        lon, lat = rng.uniform(-180, 180), rng.choice([rng.uniform(-90, 90), 90.0, -90.0, 60.0])
        radius = rng.uniform(0.01, 500)
        boxes = search_boxes(lon, lat, radius)
        angle, bearing = radius / EARTH_RADIUS_KM, rng.uniform(0, 2 * np.pi, 200)
        phi = math.radians(lat)
        lat2 = np.arcsin(np.sin(phi) * np.cos(angle) + np.cos(phi) * np.sin(angle) * np.cos(bearing))
        lon2 = math.radians(lon) + np.arctan2(
            np.sin(bearing) * np.sin(angle) * np.cos(phi), np.cos(angle) - np.sin(phi) * np.sin(lat2)
        )
        x = (np.degrees(lon2) + 180) % 360 - 180
        y = np.degrees(lat2)
        held = np.zeros(len(x), bool)
        for box in boxes:
            held |= (box.min_lon <= x) & (x <= box.max_lon) & (box.min_lat <= y) & (y <= box.max_lat)
        assert held.all()


def test_known_city_distances(spark):
    """Longitude first: a swap of the axes would be off by hundreds of metres here."""
    places = spark.createDataFrame(
        [(1, 2.2945, 48.8584), (2, 2.3376, 48.8606), (3, 2.3499, 48.8530)], "id int, lon double, lat double"
    )
    found = nearest.nearest(with_bbox(places), 2.3499, 48.8530, 10.0, geometry=None, columns=["id"]).collect()
    by_id = {r["id"]: r["distance_km"] for r in found}
    assert by_id[3] == 0.0
    assert by_id[2] == pytest.approx(1.235, abs=0.005)
    assert by_id[1] == pytest.approx(4.097, abs=0.01)


@pytest.mark.parametrize("centre", [(2.3, 48.8), (179.8, -12.0), (-179.9, 70.0), (45.0, 88.0), (0.0, -90.0)])
def test_nearest_equals_a_full_scan(spark, centre):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.uniform(-180, 180, 4000), rng.normal(centre[0], 4, 1000)])
    x = (x + 180) % 360 - 180
    y = np.clip(np.concatenate([rng.uniform(-90, 90, 4000), rng.normal(centre[1], 4, 1000)]), -90, 90)
    found = nearest.nearest(point_frame(spark, x, y), *centre, 500.0, geometry=None, columns=["id"], k=40).collect()
    distance = np.round(haversine(x, y, *centre), 4)
    wanted = sorted((d, i) for i, d in enumerate(distance) if d <= 500.0)[:40]
    assert [r["id"] for r in found] == [i for _, i in wanted]
    assert [r["distance_km"] for r in found] == pytest.approx([d for d, _ in wanted], abs=1e-4)


def test_coordinates_from_wkb(spark):
    df = point_frame(spark, np.array([1.5, -2.25]), np.array([3.125, 4.0])).withColumn("geometry", st_point("lon", "lat"))
    # Bounding boxes rounded to 32 bits, as published files have them, must not matter.
    loose = df.withColumn(
        "bbox",
        F.struct(
            (F.col("lon") - 0.01).alias("xmin"),
            (F.col("lon") + 0.01).alias("xmax"),
            (F.col("lat") - 0.01).alias("ymin"),
            (F.col("lat") + 0.01).alias("ymax"),
        ),
    )
    row = nearest.nearest(loose, 1.5, 3.125, 5.0, columns=["id"]).collect()
    assert [(r["id"], r["distance_km"]) for r in row] == [(0, 0.0)]


def test_float32_bbox_is_pushed_down(spark, tmp_path):
    path = str(tmp_path / "f32")
    member = [F.col("v").cast("float").alias(m) for m in ("xmin", "xmax", "ymin", "ymax")]
    spark.range(100).select((F.col("id") * 0.1).alias("v")).select(F.struct(*member).alias("bbox")).write.parquet(path)
    df = spark.read.parquet(path).where(BoundingBox(0.5, 0.5, 2.05, 2.05).intersects())
    assert "PushedFilters: [IsNotNull(bbox.xmin)" in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 16


def test_many_rectangles_in_one_scan(spark):
    x = np.arange(100) / 10.0
    df = point_frame(spark, x, x)
    boxes = [BoundingBox(0.0, 0.0, 1.0, 1.0), BoundingBox(0.5, 0.5, 1.5, 1.5), BoundingBox(9.0, 9.0, 9.25, 9.25)]
    assert df.where(intersects_any(boxes)).count() == 16 + 3
    with pytest.raises(InvalidRequestError):
        intersects_any([])


# -- geometry -------------------------------------------------------------------------


def test_wkb_variants():
    point = geo.from_wkt("POINT (1 2)")
    big_endian = bytes.fromhex("00000000013ff00000000000004000000000000000")
    with_z = bytes.fromhex("01e9030000000000000000f03f00000000000000400000000000000840")
    with_srid = bytes.fromhex("0101000020e6100000000000000000f03f0000000000000040")
    for data in (geo.to_wkb(point), big_endian, with_z, with_srid):
        kind, xy = geo.from_wkb(data)
        assert kind == "Point" and xy.tolist() == [[1.0, 2.0]]


SQUARE = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))"


@pytest.mark.parametrize(
    ("inner", "contained", "meeting"),
    [
        ("POINT (3 3)", True, True),
        ("POINT (1.5 1.5)", False, False),
        ("POINT (0 2)", False, True),
        ("POINT (4 4)", False, True),
        ("POINT (1 1.5)", False, True),
        ("POINT (5 5)", False, False),
        ("LINESTRING (0 0, 4 0)", False, True),
        ("LINESTRING (0 0, 4 4)", False, True),
        ("LINESTRING (0.5 0.5, 0.6 0.6)", True, True),
        ("LINESTRING (-1 2, 5 2)", False, True),
        ("POLYGON ((2.5 2.5, 3 2.5, 3 3, 2.5 2.5))", True, True),
        ("POLYGON ((0.5 0.5, 3 0.5, 3 3, 0.5 3, 0.5 0.5))", False, True),
        ("POLYGON ((1 1, 2 1, 2 2, 1 2, 1 1))", False, True),
        ("POLYGON ((1.2 1.2, 1.8 1.2, 1.8 1.8, 1.2 1.2))", False, False),
        ("POLYGON ((-1 -1, 9 -1, 9 9, -1 9, -1 -1))", False, True),
        ("MULTIPOINT ((3 3), (0 2))", True, True),
        ("MULTIPOINT ((3 3), (5 5))", False, True),
        (SQUARE, True, True),
    ],
)
def test_contains_and_intersects(inner, contained, meeting):
    outer, other = geo.from_wkt(SQUARE), geo.from_wkt(inner)
    assert geo.contains(outer, other) is contained
    assert geo.intersects(outer, other) is meeting
    assert geo.intersects(other, outer) is meeting


def test_shape_test_per_row_and_per_literal_agree(spark):
    rng = np.random.default_rng(8)
    ring = star(rng, 0, 0, 10, 300)
    shape = Shape("POLYGON ((" + ", ".join(f"{x!r} {y!r}" for x, y in ring.tolist()) + "))")
    x, y = rng.uniform(-10, 10, 2000), rng.uniform(-10, 10, 2000)
    df = point_frame(spark, x, y).withColumn("geometry", st_point("lon", "lat"))
    by_xy = {r["id"] for r in df.where(shape.touches_point(F.col("lon"), F.col("lat"))).select("id").collect()}
    by_wkb = {r["id"] for r in df.where(shape.intersects_wkb(F.col("geometry"))).select("id").collect()}
    odd, on = geo.locate(x, y, geo.ring_edges([ring]))
    assert by_xy == by_wkb == set(np.flatnonzero(odd | on))


# -- tiles and containment ------------------------------------------------------------


def test_tiles_decide_like_the_whole_polygon():
    rng = np.random.default_rng(1)
    for trial in range(60):
        n, radius = int(rng.choice([3, 5, 20, 200, 2000])), float(rng.choice([0.001, 0.5, 20]))
        cx, cy = rng.uniform(-150, 150), rng.uniform(-60, 60)
        digits = 2 if trial % 3 == 0 else None
        rings = [star(rng, cx, cy, radius, n, digits)]
        if trial % 2:
            rings.append(star(rng, cx, cy, radius / 4, max(3, n // 3)))
        level, keys, counts, edges = tiles.cut(rings)
        assert len(set(keys)) == len(keys)
        assert len(keys) + len(edges) <= 3 * (16 + 4 * sum(map(len, rings)))
        x, y = rng.uniform(cx - radius, cx + radius, 2000), rng.uniform(cy - radius, cy + radius, 2000)
        x, y = np.concatenate([x, rings[0][:200, 0]]), np.concatenate([y, rings[0][:200, 1]])
        if digits:
            x, y = np.round(x, digits), np.round(y, digits)
        odd, on = geo.locate(x, y, geo.ring_edges(rings))
        point_keys = (level << 50) + (tiles._cells(x, 180.0, level) << 25) + tiles._cells(y, 90.0, level)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        where = {key: i for i, key in enumerate(keys)}
        found = np.array([where.get(key, -1) for key in point_keys])
        got = np.zeros(len(x), bool)
        for i in np.flatnonzero(found >= 0):
            own = edges[offsets[found[i]] : offsets[found[i] + 1]]
            inside, touching = geo.locate(x[i : i + 1], y[i : i + 1], own)
            got[i] = not len(own) or (inside[0] and not touching[0])
        assert (got == (odd & ~on)).all()


@pytest.fixture(scope="module")
def mosaic():
    """Overlapping polygons of very different sizes and details; points with heavy repeats
    and many exactly on vertices."""
    rng = np.random.default_rng(11)
    named = []
    for i in range(60):
        radius = float(rng.choice([0.05, 1.0, 8.0, 40.0]))
        cx, cy = rng.uniform(-120, 120), rng.uniform(-45, 45)
        n = int(rng.choice([3, 6, 30, 400]))
        rings = [star(rng, cx, cy, radius, n, 1 if i % 4 == 0 else None)]
        if i % 3 == 0:
            rings.append(star(rng, cx, cy, radius / 5, 8))
        named.append((f"area {i % 50}", "odd" if i % 2 else "even", rings))
    x, y = rng.uniform(-160, 160, 6000), rng.uniform(-80, 80, 6000)
    centres = [r[0].mean(axis=0) + 0.3 * (r[0][0] - r[0].mean(axis=0)) for _, _, r in named]
    spot = np.repeat(np.array(centres[:5]), 700, axis=0)
    corners = np.concatenate([r[0] for _, _, r in named[::4]])
    xy = np.concatenate([np.column_stack([x, y]), spot, corners, np.array([[180.0, 90.0], [-180.0, -90.0]])])
    wanted = {}
    for name, subtype, rings in named:
        odd, on = geo.locate(xy[:, 0], xy[:, 1], geo.ring_edges(rings))
        if (odd & ~on).any():
            wanted[name, subtype] = wanted.get((name, subtype), 0) + int((odd & ~on).sum())
    return named, xy, wanted


@pytest.mark.parametrize(
    "options",
    [{}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "tile_pairs": 50}],
    ids=["broadcast", "shuffled", "hot tiles"],
)
@pytest.mark.parametrize("edges_per_row", [2048, 3], ids=["whole tiles", "spread tiles"])
def test_counts_equal_brute_force(spark, mosaic, options, edges_per_row):
    named, xy, wanted = mosaic
    polygons = spark.createDataFrame(polygon_rows(named), POLYGON_SCHEMA)
    points = point_frame(spark, xy[:, 0], xy[:, 1])
    staged = containment.stage(
        containment.tile_table(
            polygons, [F.col("names.primary").alias("polygon_name"), F.col("subtype").alias("polygon_subtype")], edges_per_row=edges_per_row
        ),
        "test-tiles",
    )
    assert (staged.agg(F.max("chunks")).first()[0] > 1) == (edges_per_row == 3)
    pairs = containment.contained_pairs(
        containment.with_coordinates(points, geometry=None), staged, polygon_columns=["polygon_name", "polygon_subtype"], **options
    )
    rows = pairs.groupBy("polygon_name", "polygon_subtype").agg(F.count("*").alias("n")).collect()
    assert {(r["polygon_name"], r["polygon_subtype"]): r["n"] for r in rows} == wanted


@pytest.mark.parametrize(
    "options",
    [{}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "tile_pairs": 5}],
    ids=["broadcast", "shuffled", "hot tiles"],
)
@pytest.mark.parametrize("edges_per_row", [2048, 3], ids=["whole tiles", "spread tiles"])
def test_areas_in_polygons_equal_brute_force(spark, mosaic, options, edges_per_row):
    named, _, _ = mosaic
    rng = np.random.default_rng(21)
    inner = [star(rng, rng.uniform(-120, 120), rng.uniform(-45, 45), float(rng.choice([0.01, 0.5, 3])), 6) for _ in range(400)]
    for _, _, rings in named[:20]:
        centre = rings[0].mean(axis=0)
        inner.append(star(rng, *(centre + 0.5 * (rings[0][1] - centre)), 0.004, 5))
        inner.append(rings[0])
    inner = [("Polygon", [ring]) for ring in inner]
    wanted = {}
    for name, subtype, rings in named:
        n = sum(geo.contains(("Polygon", rings), g) for g in inner)
        if n:
            wanted[name, subtype] = wanted.get((name, subtype), 0) + n
    polygons = spark.createDataFrame(polygon_rows(named), POLYGON_SCHEMA)
    areas = spark.createDataFrame([(bytearray(geo.to_wkb(g)),) for g in inner], "geometry binary")
    keep = [
        F.col("names.primary").alias("polygon_name"),
        F.col("subtype").alias("polygon_subtype"),
        containment._outline(F.col("geometry")).alias("__env"),
    ]
    staged = containment.stage(containment.tile_table(polygons, keep, edges_per_row=edges_per_row), "test-areas")
    found = containment.areas_in_polygons(areas, staged, ["polygon_name", "polygon_subtype"], **options)
    rows = found.groupBy("polygon_name", "polygon_subtype").agg(F.sum("weight").alias("n")).collect()
    assert {(r["polygon_name"], r["polygon_subtype"]): r["n"] for r in rows} == wanted
    assert sum(wanted.values()) > 30


def test_containment_never_compares_all_pairs(spark, mosaic):
    named, xy, _ = mosaic
    polygons = spark.createDataFrame(polygon_rows(named), POLYGON_SCHEMA)
    points = point_frame(spark, xy[:, 0], xy[:, 1])
    for options in ({}, {"broadcast_bytes": 0}):
        plan = containment.count_in_polygons(points, polygons, point_geometry=None, **options)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        assert ("SortMergeJoin" in plan) == bool(options)


def test_stacked_polygons_are_split_too(spark, monkeypatch):
    """One tile holding most points and most polygons."""
    monkeypatch.setattr(containment, "TILE_POLYGONS", 7)
    rng = np.random.default_rng(31)
    named = [(f"p{i}", "x", [star(rng, 10.0, 10.0, 5.0, 9)]) for i in range(40)]
    xy = np.concatenate([rng.uniform(5, 15, (500, 2)), np.full((300, 2), 10.25)])
    wanted = {}
    for name, _, rings in named:
        odd, on = geo.locate(xy[:, 0], xy[:, 1], geo.ring_edges(rings))
        wanted[name] = int((odd & ~on).sum())
    rows = containment.count_in_polygons(
        point_frame(spark, xy[:, 0], xy[:, 1]),
        spark.createDataFrame(polygon_rows(named), POLYGON_SCHEMA),
        point_geometry=None,
        broadcast_bytes=0,
        tile_pairs=500,
    ).collect()
    assert {r["polygon_name"]: r["feature_count"] for r in rows} == wanted


def test_points_without_coordinates_are_nowhere(spark):
    everywhere = [("world", "x", [np.array([[-180, -90], [180, -90], [180, 90], [-180, 90], [-180, -90.0]])])]
    x = np.array([0.0, np.nan, 1.0, np.inf, -np.inf])
    y = np.array([0.0, 0.0, np.nan, 0.0, 0.0])
    polygons = spark.createDataFrame(polygon_rows(everywhere), POLYGON_SCHEMA)
    df = point_frame(spark, x, y).unionByName(point_frame(spark, x, y).withColumn("bbox", F.lit(None).cast("struct<xmin:double,xmax:double,ymin:double,ymax:double>")))
    assert containment.count_in_polygons(df, polygons, point_geometry=None).first()["feature_count"] == 1


def test_a_rectangle_drops_far_tiles_only(spark, mosaic):
    named, xy, _ = mosaic
    polygons = spark.createDataFrame(polygon_rows(named), POLYGON_SCHEMA)
    box = BoundingBox(-20.0, -15.0, 25.0, 30.0)
    inside = (xy[:, 0] >= -20) & (xy[:, 0] <= 25) & (xy[:, 1] >= -15) & (xy[:, 1] <= 30)
    wanted = {}
    for name, _, rings in named:
        odd, on = geo.locate(xy[inside, 0], xy[inside, 1], geo.ring_edges(rings))
        if (odd & ~on).any():
            wanted[name] = wanted.get(name, 0) + int((odd & ~on).sum())
    rows = containment.count_in_polygons(
        point_frame(spark, xy[:, 0], xy[:, 1]), polygons, box, point_geometry=None
    ).collect()
    assert {r["polygon_name"]: r["feature_count"] for r in rows} == wanted
    every, near = containment.tile_table(polygons), containment.tile_table(polygons, box=box)
    assert near.count() < every.count() / 2


def test_counts_on_a_stream(spark, tmp_path):
    """Without a row limit the grouped operators also run over a stream."""
    x = np.arange(200) / 10.0
    point_frame(spark, x, x).withColumn("kind", (F.col("id") % 3).cast("string")).write.parquet(str(tmp_path / "in"))
    static = spark.read.parquet(str(tmp_path / "in"))
    box = BoundingBox(0.0, 0.0, 10.0, 10.0)
    for name, run in {
        "groups": lambda df: aggregate.group_aggregate(df, "kind", box=box),
        "cells": lambda df: aggregate.cell_density(df, box, 3),
    }.items():
        stream = run(spark.readStream.schema(static.schema).parquet(str(tmp_path / "in")))
        query = stream.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
        query.awaitTermination()
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, run(static).collect()))


def test_no_polygons_and_no_points(spark, mosaic):
    named, xy, _ = mosaic
    polygons = spark.createDataFrame(polygon_rows(named), POLYGON_SCHEMA)
    points = point_frame(spark, xy[:, 0], xy[:, 1])
    assert containment.count_in_polygons(points, polygons.where("false"), point_geometry=None).count() == 0
    assert containment.count_in_polygons(points.where("false"), polygons, point_geometry=None).count() == 0


def test_pairs_keep_their_points(spark, mosaic):
    named, xy, _ = mosaic
    pairs = containment.points_in_polygons(
        point_frame(spark, xy[:, 0], xy[:, 1]),
        spark.createDataFrame(polygon_rows(named), POLYGON_SCHEMA),
        point_columns=["id"],
        polygon_columns=["names.primary AS polygon_name", "subtype"],
        point_geometry=None,
    ).collect()
    wanted = set()
    for name, subtype, rings in named:
        odd, on = geo.locate(xy[:, 0], xy[:, 1], geo.ring_edges(rings))
        wanted |= {(int(i), name, subtype) for i in np.flatnonzero(odd & ~on)}
    assert {(r["id"], r["polygon_name"], r["subtype"]) for r in pairs} == wanted


@pytest.mark.parametrize("limits", [{}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "tile_pairs": 10}, {"broadcast_bytes": 0, "tile_pairs": 1}])
def test_equal_points_are_rows_of_their_own_at_every_limit(spark, mosaic, limits):
    named, xy, wanted = mosaic
    thrice = np.concatenate([xy, xy, xy])
    pairs = containment.points_in_polygons(
        point_frame(spark, thrice[:, 0], thrice[:, 1]).select(F.lit("p").alias("label"), "bbox"),
        spark.createDataFrame(polygon_rows(named), POLYGON_SCHEMA),
        point_columns=["label"], polygon_columns=["names.primary AS polygon_name", "subtype"], point_geometry=None, **limits,
    )
    assert pairs.columns == ["label", "polygon_name", "subtype"]
    got = {(r["polygon_name"], r["subtype"]): r["count"] for r in pairs.groupBy("polygon_name", "subtype").count().collect()}
    assert got == {k: 3 * n for k, n in wanted.items()}


@pytest.mark.parametrize("limits", [{}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "tile_pairs": 10}], ids=["broadcast", "shuffled", "hot tiles"])
def test_equal_shapes_and_points_cost_their_tiles_once(spark, mosaic, monkeypatch, limits):
    named, xy, wanted = mosaic
    held = {}

    def staged(df, name, keep=containment.stage):
        held[name] = keep(df, name)
        return held[name]

    monkeypatch.setattr(containment, "stage", staged)
    monkeypatch.setattr(containment, "COPIES_AT_ONCE", 3, raising=False)
    seen = []
    for times in (1, 5):
        again = [(f"{name} {k % 3}", subtype, rings) for name, subtype, rings in named for k in range(times)]
        many = point_frame(spark, *np.repeat(xy, times, axis=0).T).withColumn("label", F.lit("p"))
        polygons = spark.createDataFrame(polygon_rows(again), POLYGON_SCHEMA)
        share = {f"{k % 3}": len(range(k, times, 3)) for k in range(min(times, 3))}
        expected = {(f"{name} {k}", subtype): n * times * copies for (name, subtype), n in wanted.items() for k, copies in share.items()}
        rows = containment.count_in_polygons(many, polygons, point_geometry=None, subtype_column="subtype", **limits).collect()
        assert {(r["polygon_name"], r["polygon_subtype"]): r["feature_count"] for r in rows} == expected
        seen.append((held["tiles"].count(), held["tile-load"].agg(F.max("pairs")).first()[0] if limits else 0))
        pairs = containment.points_in_polygons(
            many, polygons, point_columns=["label"], polygon_columns=["names.primary AS polygon_name", "subtype"], point_geometry=None, **limits
        )
        assert {(r["polygon_name"], r["subtype"]): r["count"] for r in pairs.groupBy("polygon_name", "subtype").count().collect()} == expected
    assert seen[0] == seen[1]


def test_names_travel_with_the_tiles_of_many_single_shapes(spark, mosaic, monkeypatch):
    named, xy, wanted = mosaic
    monkeypatch.setattr(containment, "BROADCAST_BYTES", 0)
    pairs = containment.points_in_polygons(
        point_frame(spark, xy[:, 0], xy[:, 1]), spark.createDataFrame(polygon_rows([*named, named[0]]), POLYGON_SCHEMA),
        point_columns=["id"], polygon_columns=["names.primary AS polygon_name", "subtype"], point_geometry=None, broadcast_bytes=0,
    )
    got = {(r["polygon_name"], r["subtype"]): r["count"] for r in pairs.groupBy("polygon_name", "subtype").count().collect()}
    name, subtype, rings = named[0]
    odd, on = geo.locate(xy[:, 0], xy[:, 1], geo.ring_edges(rings))
    assert got == wanted | {(name, subtype): wanted[name, subtype] + int((odd & ~on).sum())}


# -- statistics -----------------------------------------------------------------------


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_quantiles_equal_numpy(spark, size):
    rng = np.random.default_rng(size)
    values = np.round(rng.normal(100, 30, size), 1)
    values[rng.random(size) < 0.3] = 42.0
    df = spark.createDataFrame(pd.DataFrame({"v": values})).repartition(5)
    row = statistics.quartiles(df, "v").first()
    assert list(row) == pytest.approx(np.quantile(values, [0.25, 0.5, 0.75]).tolist())


def _plain_quartiles(values: list) -> list[float]:
    ordered = sorted(values)
    out = []
    for fraction in (0.25, 0.5, 0.75):
        place = fraction * (len(ordered) - 1)
        low, high = float(ordered[math.floor(place)]), float(ordered[math.ceil(place)])
        out.append(low if low == high else low + (high - low) * (place - math.floor(place)))
    return out


_rng = np.random.default_rng(8)
SPREADS = {
    "magnitudes": ("double", (10.0 ** _rng.uniform(-200, 200, 3000)).tolist()),
    "signed magnitudes": ("double", (_rng.choice([-1, 1], 3000) * 10.0 ** _rng.uniform(-30, 30, 3000)).tolist()),
    "outliers": ("double", [*_rng.normal(0, 1, 3000).tolist(), 1e308, -1e308, math.inf, -math.inf]),
    "infinite": ("double", [math.inf] * 40 + [1.7976931348623157e308] * 41),
    "few values": ("double", _rng.choice([1.5, 1.5000000000000002, 7.0], 3000).tolist()),
    "floats": ("float", np.float32(_rng.normal(5, 2, 3000)).tolist()),
    "large longs": ("bigint", [2**62 + int(k) for k in _rng.integers(0, 3000, 3000)]),
    "longs": ("bigint", [int(k) for k in _rng.integers(-(2**63), 2**63 - 1, 3000)]),
    "decimals": ("decimal(20,3)", [Decimal(int(k)) / 1000 for k in _rng.integers(-(10**9), 10**9, 3000)]),
}


@pytest.mark.parametrize("name", SPREADS)
def test_quartiles_by_narrowing(spark, monkeypatch, name):
    monkeypatch.setattr(statistics, "LAST_ROWS", 20)
    monkeypatch.setattr(statistics, "BUCKETS", 16)
    kind, values = SPREADS[name]
    df = spark.createDataFrame([(v,) for v in [*values, None]], f"v {kind}").repartition(4)
    row = statistics.quartiles(df, "v").first()
    assert list(row) == pytest.approx(_plain_quartiles(values), rel=1e-12)
    assert list(statistics.column_stats(df, "v").summary.select("p25", "median", "p75").first()) == pytest.approx(list(row), rel=1e-12)


def test_quartiles_shuffle_counts_and_not_values(spark):
    values = spark.range(60_000).select((F.col("id") * 7919 % 50_021).cast("double").alias("v")).repartition(4)
    asked = []
    original = statistics._narrowed
    statistics._narrowed = lambda v, intervals, ranks: asked.append(len(ranks)) or original(v, intervals, ranks)
    try:
        row = statistics.quartiles(values, "v").first()
    finally:
        statistics._narrowed = original
    assert len(asked) == 1  # one narrowing for all ranks together, then 15 rows a bucket are sorted
    ordered = sorted(int(k) * 7919 % 50_021 for k in range(60_000))
    assert list(row) == pytest.approx(_plain_quartiles(ordered))


def test_statistics_without_numbers(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "v double")
    assert statistics.quartiles(df, "v").first()["median"] is None
    assert statistics.histogram(df, "v").count() == 0
    constant = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert statistics.histogram(constant, "v").count() == 0
    profile = statistics.column_stats(constant, "v")
    assert profile.summary.first()["stddev"] == 0.0 and profile.distribution.count() == 0
    with pytest.raises(InvalidRequestError):
        statistics.histogram(spark.createDataFrame([("a",)], "v string"), "v")


def test_histogram_leaves_out_empty_buckets_and_nulls(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (10.0,), (None,)], "v double")
    rows = statistics.histogram(df, "v", 5).orderBy("bucket").collect()
    assert [(r["bucket"], r["count"], r["share"]) for r in rows] == [(0, 2, 0.5), (4, 1, 0.25)]
    assert (rows[1]["lower_bound"], rows[1]["upper_bound"]) == (8.0, 10.0)


def test_top_values_counts_null_as_a_value(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), (None,), ("a",), ("b",)], "v string")
    rows = statistics.top_values(df, "v").collect()
    assert [(r["value"], r["count"]) for r in rows] == [("a", 2), ("b", 2), (None, 2)]


def test_other_types_are_categorical(spark):
    df = spark.sql("SELECT date'2020-01-01' AS d, true AS b UNION ALL SELECT date'2021-01-01', false")
    assert statistics.column_stats(df, "d").summary.first()["maximum"] == "2021-01-01"
    assert statistics.column_stats(df, "b").distribution.count() == 2


# -- cells ----------------------------------------------------------------------------


@pytest.mark.parametrize("grid", ["quad", "hex"])
def test_centre_lies_in_its_own_cell(spark, grid):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(pd.DataFrame({"lon": rng.uniform(-179, 179, 500), "lat": rng.uniform(-80, 80, 500)}))
    for resolution in (0, 5, 11, 15):
        cells = df.select(cell_id(F.col("lon"), F.col("lat"), resolution, grid).alias("c"))
        lon, lat = cell_centre(F.col("c"), resolution, grid)
        moved = cells.select("c", cell_id(lon, lat, resolution, grid).alias("again"))
        if resolution > 0:
            assert moved.where("c <> again").count() == 0


def test_quad_cells_nest(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame(pd.DataFrame({"lon": rng.uniform(-180, 180, 3000), "lat": rng.uniform(-90, 90, 3000)}))
    for resolution in range(6):
        pair = df.select(
            cell_id(F.col("lon"), F.col("lat"), resolution).alias("coarse"),
            cell_id(F.col("lon"), F.col("lat"), resolution + 1).alias("fine"),
        )
        assert pair.groupBy("fine").agg(F.count_distinct("coarse").alias("n")).where("n > 1").count() == 0


# -- footers --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def layouts(tmp_path_factory):
    """The same points sorted by longitude and shuffled, 20 row groups each."""
    rng = np.random.default_rng(6)
    x, y = np.sort(rng.uniform(-180, 180, 20_000)), rng.uniform(-90, 90, 20_000)
    folder, paths = tmp_path_factory.mktemp("layouts"), {}
    for name, order in (("sorted", np.arange(20_000)), ("shuffled", rng.permutation(20_000))):
        bbox = pa.StructArray.from_arrays(
            [pa.array(v[order]) for v in (x, x, y, y)], ["xmin", "xmax", "ymin", "ymax"]
        )
        table = pa.table({"id": pa.array(order), "bbox": bbox, "geometry": pa.array([b"x" * 60] * 20_000)})
        (folder / name).mkdir()
        pq.write_table(table, folder / name / "part-0.parquet", row_group_size=1000)
        paths[name] = str(folder / name)
    return paths, x, y


def test_scan_report_equals_enumeration(spark, layouts):
    paths, x, y = layouts
    box = BoundingBox(10.0, -20.0, 40.0, 30.0)
    found = {}
    for name, path in paths.items():
        table = footers.footers(spark, path)
        meta = pq.read_metadata(f"{path}/part-0.parquet")
        wanted_groups = wanted_bytes = 0
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(6)}
            stats = {k: c.statistics for k, c in columns.items() if k.startswith("bbox.")}
            if (
                stats["bbox.xmin"].min <= box.max_lon
                and stats["bbox.xmax"].max >= box.min_lon
                and stats["bbox.ymin"].min <= box.max_lat
                and stats["bbox.ymax"].max >= box.min_lat
            ):
                wanted_groups += 1
                wanted_bytes += sum(c.total_compressed_size for k, c in columns.items() if k != "geometry")
        found[name] = footers.scan_report(table, ["id"], box).first()
        assert (found[name]["row_groups_read"], found[name]["bytes_scanned"]) == (wanted_groups, wanted_bytes)
        with_geometry = footers.scan_report(table, ["id", "geometry"], box).first()
        assert with_geometry["bytes_scanned"] > found[name]["bytes_scanned"]
    assert found["sorted"]["pruning_ratio"] > 5 and found["shuffled"]["pruning_ratio"] == 1.0


def test_odd_file_names(spark, tmp_path):
    for name in ("with space", "a%20b", "hash#tag"):
        pq.write_table(pa.table({"v": [1, 2, 3]}), tmp_path / f"{name}.parquet")
    row = footers.footprint(footers.footers(spark, str(tmp_path))).first()
    assert (row["files"], row["row_count"], row["row_groups"]) == (3, 9, 3)


def test_missing_statistics(spark, tmp_path):
    bbox = pa.StructArray.from_arrays([pa.array([1.0, 2.0])] * 4, ["xmin", "xmax", "ymin", "ymax"])
    pq.write_table(pa.table({"bbox": bbox}), tmp_path / "a.parquet", write_statistics=False)
    none = footers.footers(spark, str(tmp_path))
    with pytest.raises(StatisticsMissingError):
        footers.require_extent(footers.extent(none), "x")
    assert footers.scan_report(none, ["bbox"], BoundingBox(50.0, 50.0, 60.0, 60.0)).first()["row_groups_read"] == 1
    pq.write_table(pa.table({"bbox": bbox}), tmp_path / "b.parquet")
    row = footers.extent(footers.footers(spark, str(tmp_path))).first()
    assert (row["min_lon"], row["complete"]) == (1.0, False)
    assert footers.geo_metadata(none).first().asDict() == {
        "crs": None,
        "crs_is_default": None,
        "encoding": None,
        "geometry_types": [],
        "geoparquet_version": None,
    }


@pytest.mark.parametrize(
    ("crs", "wanted"),
    [
        ('{"id": {"authority": "EPSG", "code": 4326}}', "EPSG:4326"),
        ('{"name": "My CRS"}', "My CRS"),
        ("{}", "unknown"),
        ('"EPSG:3857"', "EPSG:3857"),
        ("null", "OGC:CRS84"),
    ],
)
def test_crs_names(spark, tmp_path, crs, wanted):
    document = f'{{"version": "1.0.0", "primary_column": "g", "columns": {{"g": {{"encoding": "WKB", "crs": {crs}}}}}}}'
    table = pa.table({"g": pa.array([b""])}).replace_schema_metadata({"geo": document})
    pq.write_table(table, tmp_path / "a.parquet")
    row = footers.geo_metadata(footers.footers(spark, str(tmp_path))).first()
    assert row["crs"] == wanted and row["crs_is_default"] == (crs == "null")


# -- features -------------------------------------------------------------------------


def test_features_as_lines(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 'quote " and \\', None, '{"type":"Point","coordinates":[1.0,2.0]}')],
        f"id int, name string, other string, {features.GEOMETRY} string",
    )
    features.to_features(df).write.text(str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out")).first()
    assert back["id"] == 1 and back["properties"]["name"] == 'quote " and \\'
    assert back["geometry"]["coordinates"] == [1.0, 2.0]
    line = features.to_features(df).first()["feature"]
    assert '"other":null' in line
    bare = df.drop("id", "other", "name")
    assert features.to_features(bare).first()["feature"].endswith('"properties":{}}')


def test_extent_and_top(spark):
    df = point_frame(spark, np.array([1.0, 5.0]), np.array([-3.0, 7.0]))
    assert list(features.extent_by_scan(df).first()) == [1.0, -3.0, 5.0, 7.0, 2]
    with pytest.raises(InvalidRequestError):
        aggregate.top(df, 0)
