"""Spatial predicates in SQL: the rows of the text as written, by a plan without nested loops."""

from __future__ import annotations

import math
import random

import pytest

from tessera import ship
from tessera.errors import InvalidRequestError
from tessera.functions import geometry as geo
from tessera.functions.spatial import register_functions
from tessera.plans import sqlgate
from tessera.sources.catalog import Catalog, Source

BBOX = "bbox struct<xmin: double, xmax: double, ymin: double, ymax: double>"


def _with_box(name, wkt, *more):
    if wkt is None:
        return (name, *more, (None,) * 4, None)
    shape = geo.from_wkt(wkt)
    xy = geo.vertices(shape)
    box = tuple(map(float, (xy[:, 0].min(), xy[:, 0].max(), xy[:, 1].min(), xy[:, 1].max()))) if len(xy) else (None,) * 4
    return (name, *more, box, bytes(geo.to_wkb(shape)))


def _star(rng: random.Random, x: float, y: float, size: float, corners: int) -> str:
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(corners))
    ring = [(x + size * rng.uniform(0.3, 1) * math.cos(t), y + size * rng.uniform(0.3, 1) * math.sin(t)) for t in turns]
    return "((" + ", ".join(f"{a} {b}" for a, b in [*ring, ring[0]]) + "))"


@pytest.fixture(scope="module")
def tables(spark):
    ship(spark)
    rng = random.Random(11)
    areas = [_with_box(f"a{k}", f"POLYGON {_star(rng, rng.uniform(-20, 20), rng.uniform(-20, 20), rng.choice([0.5, 4, 15]), rng.randint(3, 40))}", str(k % 4)) for k in range(30)]
    areas += [
        _with_box("square", "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 4 2, 4 4, 2 4, 2 2))", "1"),
        _with_box("square", "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 4 2, 4 4, 2 4, 2 2))", "1"),
        _with_box("parts", "MULTIPOLYGON (((-9 -9, -5 -9, -5 -5, -9 -9)), ((5 -9, 9 -9, 9 -5, 5 -9)))", "2"),
        _with_box("none", None, "2"), _with_box("empty", "POLYGON EMPTY", "3"),
    ]
    places = [_with_box(k, f"POINT ({rng.uniform(-25, 25)} {rng.uniform(-25, 25)})", k % 7) for k in range(300)]
    places += [_with_box(300 + k, f"POINT ({x} {y})", 1) for k, (x, y) in enumerate((x, y) for x in range(0, 12, 2) for y in range(0, 12, 2))]
    places += [places[0], _with_box(900, None, 3), _with_box(901, "POINT EMPTY", 3)]
    frames = {
        "areas": spark.createDataFrame(areas, f"name string, subtype string, {BBOX}, geometry binary").repartition(3),
        "places": spark.createDataFrame(places, f"id int, kind int, {BBOX}, geometry binary").repartition(3),
        "more": spark.createDataFrame(places[:40], f"id int, kind int, {BBOX}, geometry binary"),
        "lines": spark.createDataFrame([_with_box(1, "LINESTRING (0 0, 1 1)", 0)], f"id int, kind int, {BBOX}, geometry binary"),
    }
    sources = [Source(name=n, view=lambda _, n=n: frames[n], name_column=None, polygonal=n == "areas") for n in frames]
    return frames, Catalog.of("test", *sources)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def plainly(spark, frames, sql):
    register_functions(spark)
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
    try:
        return spark.sql(sql)
    finally:
        for name in frames:
            spark.catalog.dropTempView(name)


JOINS = [
    "SELECT a.name, p.id FROM areas a JOIN places p ON st_contains(a.geometry, p.geometry)",
    "SELECT a.name, p.id FROM places AS p, areas AS a WHERE st_contains(a.geometry, p.geometry) AND a.subtype = '1' AND p.kind < 4",
    "SELECT areas.name, count(*) AS n FROM areas JOIN places ON st_contains(areas.geometry, places.geometry) GROUP BY areas.name HAVING count(*) > 1",
    "SELECT a.name, p.id FROM areas a JOIN places p ON st_intersects(a.geometry, p.geometry)",
    "SELECT a.name, p.id FROM areas a JOIN places p ON st_intersects(p.geometry, a.geometry) AND length(a.name) + p.kind > 4",
    "SELECT a.name, p.id FROM areas a JOIN places p ON st_contains(a.geometry, st_point(p.bbox.xmin + 0.5, p.bbox.ymin))",
    "SELECT * FROM areas a JOIN places p ON st_contains(a.geometry, p.geometry)",
    "SELECT p.*, a.name FROM areas a JOIN places p ON st_contains(a.geometry, p.geometry) WHERE a.subtype IN ('0', '2')",
    "SELECT DISTINCT a.* FROM areas a JOIN places p ON st_contains(a.geometry, p.geometry)",
    "SELECT a.name, p.id, m.id AS other FROM areas a JOIN places p ON st_contains(a.geometry, p.geometry) JOIN more m ON m.kind = p.kind AND m.id < 9",
    "SELECT a.name, p.id, m.id AS other FROM areas a JOIN places p ON st_contains(a.geometry, p.geometry) JOIN more m ON st_contains(a.geometry, m.geometry)",
    "SELECT a.name, b.name AS other, p.id FROM areas a JOIN areas b ON a.subtype = b.subtype JOIN places p ON st_contains(a.geometry, p.geometry) "
    "AND st_contains(b.geometry, p.geometry)",
    "WITH hits AS (SELECT a.name, p.id FROM areas a JOIN places p ON st_contains(a.geometry, p.geometry)) SELECT name, count(*) AS n FROM hits GROUP BY name "
    "UNION ALL SELECT 'all' AS name, (SELECT count(*) FROM areas a JOIN places p ON st_contains(a.geometry, p.geometry)) AS n",
    "SELECT a.name, p.id, row_number() OVER (PARTITION BY a.name ORDER BY p.id, p.kind) AS place FROM areas a CROSS JOIN places p WHERE st_contains(a.geometry, p.geometry)",
    "SELECT a.name, p.id FROM areas a JOIN places p ON st_contains(a.geometry, p.geometry) AND a.subtype = 'nothing'",
    "SELECT a.name, p.id FROM areas a JOIN places p ON (st_contains(a.geometry, (p.geometry))) WHERE (a.subtype) NOT IN ('1') AND a.name LIKE 'a%' "
    "AND (length(a.name) + 1) BETWEEN 2 AND 4 AND a.bbox.xmin IS NOT NULL AND (a.subtype = '0' OR a.subtype > '1')",
    "SELECT a.name, p.id FROM areas a JOIN places p ON st_contains(a.geometry, st_point((p.bbox.xmin) * (2 - 1), p.bbox.ymin))",
]


@pytest.mark.parametrize("sql", JOINS)
def test_joins_give_the_rows_of_the_text_without_nested_loops(spark, tables, sql):
    frames, catalog = tables
    got = sqlgate.run_sql(spark, catalog, sql)
    want = plainly(spark, frames, sql)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)


@pytest.mark.parametrize("sql", [*JOINS[:9], *JOINS[10:13], JOINS[15]])
def test_equal_shapes_are_cut_once(spark, tables, sql):
    frames, _ = tables
    frames = frames | {"areas": frames["areas"].unionByName(frames["areas"]).unionByName(frames["areas"].limit(9))}
    sources = [Source(name=n, view=lambda _, n=n: frames[n], name_column=None, polygonal=n == "areas") for n in frames]
    got = sqlgate.run_sql(spark, Catalog.of("test", *sources), sql)
    want = plainly(spark, frames, sql)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "__geometry_1" in plan_of(got) and "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)


KEPT = [
    "SELECT p.id, a.name FROM places p LEFT JOIN (SELECT a.name, q.id FROM areas a JOIN places q ON st_contains(a.geometry, q.geometry)) a ON a.id = p.id",
    "SELECT a.name, p.id FROM areas a JOIN places p ON st_contains(a.geometry, p.geometry) OR p.kind = 2",
    "SELECT a.name, p.id FROM areas a JOIN places p ON NOT st_contains(a.geometry, p.geometry)",
    "SELECT a.name, b.name AS other FROM areas a JOIN areas b ON st_contains(a.geometry, b.geometry)",
    "WITH areas AS (SELECT 'x' AS name, st_geomfromtext('POLYGON ((0 0, 5 0, 5 5, 0 0))') AS geometry) "
    "SELECT a.name, p.id FROM areas a JOIN places p ON st_contains(a.geometry, p.geometry)",
    "SELECT count(struct(*)) AS n FROM areas a JOIN places p ON st_contains(a.geometry, p.geometry)",
]


@pytest.mark.parametrize("sql", KEPT)
def test_other_forms_stay_as_written(spark, tables, sql):
    frames, catalog = tables
    got, want = sqlgate.run_sql(spark, catalog, sql), plainly(spark, frames, sql)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


SHAPE = "st_geomfromtext('POLYGON ((-3 -3, 8 -2, 6 9, -3 -3))')"


@pytest.mark.parametrize("sql", [
    f"SELECT id FROM places WHERE st_contains({SHAPE}, geometry)",
    f"SELECT p.id FROM places p WHERE st_intersects(p.geometry, {SHAPE}) AND p.kind > 2",
    f"SELECT name FROM areas WHERE st_intersects({SHAPE}, geometry)",
    f"SELECT a.name, p.id FROM areas a JOIN places p ON st_contains(a.geometry, p.geometry) WHERE st_intersects(p.geometry, {SHAPE})",
    f"SELECT count(*) AS n FROM (SELECT * FROM places WHERE st_intersects(geometry, {SHAPE}))",
])
def test_a_literal_shape_brings_its_rectangle(spark, tables, tmp_path, sql):
    frames, _ = tables
    sources = []
    for name, frame in frames.items():
        frame.write.parquet(f"{tmp_path}/{name}")
        sources.append(Source(name=name, view=lambda spark, n=name: spark.read.parquet(f"{tmp_path}/{n}"), name_column=None, polygonal=name == "areas"))
    got = sqlgate.run_sql(spark, Catalog.of("files", *sources), sql)
    assert sorted(map(str, got.collect())) == sorted(map(str, plainly(spark, frames, sql).collect()))
    assert any(("bbox.xmin", "<=", 8.0) in scan["comparisons"] for scan in sqlgate.file_scans(got))


def test_the_polygons_rectangle_prunes_the_points(spark, tables, tmp_path):
    frames, _ = tables
    frames["places"].write.parquet(f"{tmp_path}/places")
    catalog = Catalog.of(
        "files", Source(name="places", view=lambda spark: spark.read.parquet(f"{tmp_path}/places"), name_column=None),
        Source(name="areas", view=lambda _: frames["areas"], name_column=None, polygonal=True),
    )
    df = sqlgate.run_sql(spark, catalog, "SELECT p.id FROM areas a JOIN places p ON st_contains(a.geometry, p.geometry) WHERE a.name = 'parts'")
    (scan,) = sqlgate.file_scans(df)
    assert {("bbox.xmin", "<=", 9.0001), ("bbox.ymax", ">=", -9.0001)} <= set(scan["comparisons"])


def test_lines_are_refused_rather_than_lost(spark, tables):
    _, catalog = tables
    sql = "SELECT a.name FROM areas a JOIN lines l ON st_contains(a.geometry, l.geometry)"
    with pytest.raises(Exception, match="this takes points"):
        sqlgate.run_sql(spark, catalog, sql).collect()


def test_added_functions_are_not_for_callers(spark, tables):
    _, catalog = tables
    sqlgate.run_sql(spark, catalog, JOINS[0])
    for call in ("__st_tiles(geometry)", "__st_level(geometry)", "__st_point(geometry)"):
        with pytest.raises(InvalidRequestError, match="not available"):
            sqlgate.run_sql(spark, catalog, f"SELECT {call} FROM areas")
