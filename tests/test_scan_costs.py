"""Scan reports over whole filters, and the comparison of pushdown in awkwardly named folders."""

from __future__ import annotations

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera import ship
from tessera.errors import InvalidRequestError
from tessera.functions.boxes import BoundingBox, intersects_any
from tessera.operators import nearest
from tessera.plans import sqlgate
from tessera.plans.pushdown import path_of, pushdown_report
from tessera.sources import footers


@pytest.fixture(scope="module")
def grouped(spark, tmp_path_factory):
    """Three files of several row groups; one column without statistics, one all null in places."""
    ship(spark)
    rng = random.Random(4)
    folder = tmp_path_factory.mktemp("groups")
    groups = []
    for name in range(3):
        rows = []
        for group in range(5):
            base = rng.uniform(-50, 50)
            rows += [
                {"a": round(base + rng.uniform(-5, 5), 1), "b": rng.randrange(group * 10, group * 10 + 10), "s": rng.choice("abcxyz"[group : group + 2] or "z"),
                 "n": None if group == 2 else rng.randrange(5), "c": 7 if group == 3 else rng.randrange(9), "bare": rng.randrange(9)}
                for _ in range(20)
            ]
        table = pa.Table.from_pylist(rows)
        pq.write_table(table, f"{folder}/{name}.parquet", row_group_size=20, write_statistics=["a", "b", "s", "n", "c"])
        groups += [rows[k : k + 20] for k in range(0, 100, 20)]
    return str(folder), groups, footers.footers(spark, str(folder)).cache()


def truth(tree, row):
    """SQL's three values."""
    kind = tree[0]
    if kind in ("and", "or"):
        parts = [truth(t, row) for t in tree[1]]
        if kind == "and":
            return False if False in parts else None if None in parts else True
        return True if True in parts else None if None in parts else False
    if kind == "not":
        inner = truth(tree[1], row)
        return None if inner is None else not inner
    path, op, value = tree
    x = row[path]
    if x is None:
        return None
    return {"<=": lambda: x <= value, "<": lambda: x < value, ">=": lambda: x >= value, ">": lambda: x > value, "=": lambda: x == value, "in": lambda: x in value}[op]()


def tree_of(rng, depth):
    if depth and rng.random() < 0.75:
        kind = rng.choice(["and", "or", "not"])
        return (kind, tree_of(rng, depth - 1)) if kind == "not" else (kind, [tree_of(rng, depth - 1) for _ in range(rng.randint(1, 3))])
    path = rng.choice(["a", "b", "s", "n", "c", "bare"])
    value = (lambda: rng.choice("abcmxyz")) if path == "s" else (lambda: rng.choice([rng.randint(-60, 60), rng.uniform(-60, 60), 7]))
    op = rng.choice(["<=", "<", ">=", ">", "=", "in"])
    return path, op, [value() for _ in range(rng.randint(1, 3))] if op == "in" else value()


def column_of(tree):
    if tree[0] in ("and", "or"):
        parts = [column_of(t) for t in tree[1]]
        out = parts[0]
        for part in parts[1:]:
            out = out & part if tree[0] == "and" else out | part
        return out
    if tree[0] == "not":
        return ~column_of(tree[1])
    column, op, value = F.col(tree[0]), tree[1], tree[2]
    return {"<=": lambda: column <= value, "<": lambda: column < value, ">=": lambda: column >= value, ">": lambda: column > value,
            "=": lambda: column == value, "in": lambda: column.isin(value)}[op]()


@pytest.mark.parametrize("seed", range(40))
def test_no_group_with_a_match_is_left_out(grouped, seed):
    _, groups, table = grouped
    tree = tree_of(random.Random(seed), 3)
    report = footers.scan_report(table, ["a"], tree).first()
    assert report["row_groups_read"] >= sum(any(truth(tree, r) for r in g) for g in groups)
    assert report["row_groups"] == 15 and report["rows"] == 300


@pytest.mark.parametrize(("tree", "kept"), [
    (("or", [("b", "<", 10), ("b", ">=", 40)]), lambda g: min(r["b"] for r in g) < 10 or max(r["b"] for r in g) >= 40),
    (("not", ("b", "<=", 29)), lambda g: max(r["b"] for r in g) > 29),
    (("b", "in", [3, 1000]), lambda g: min(r["b"] for r in g) <= 3 <= max(r["b"] for r in g)),
    (("not", ("c", "=", 7)), lambda g: {r["c"] for r in g} != {7}),
    (("not", ("or", [("b", "<", 20), ("not", ("s", "<=", "b"))])), lambda g: max(r["b"] for r in g) >= 20 and min(r["s"] for r in g) <= "b"),
    (("and", [("n", ">", 100)]), lambda g: any(r["n"] is None for r in g)),
    (("bare", "=", 1000), lambda g: True),
    (None, lambda g: True),
])
def test_groups_by_their_bounds(grouped, tree, kept):
    _, groups, table = grouped
    assert footers.scan_report(table, ["a"], tree).first()["row_groups_read"] == sum(map(kept, groups))


@pytest.mark.parametrize("seed", range(12))
def test_filters_of_a_plan(spark, grouped, seed):
    folder, groups, table = grouped
    tree = tree_of(random.Random(900 + seed), 3)
    df = spark.read.parquet(folder).where(column_of(tree)).select("a")
    cost = sqlgate.query_cost(df, lambda _: table).first()
    assert cost["row_groups_read"] >= sum(any(truth(tree, r) for r in g) for g in groups)


def test_several_rectangles_cost_what_they_read(spark, tmp_path):
    rows = [{"id": k, "bbox": {"xmin": float(k), "xmax": float(k), "ymin": 0.0, "ymax": 0.0}} for k in range(100)]
    pq.write_table(pa.Table.from_pylist(rows), f"{tmp_path}/x.parquet", row_group_size=10)
    boxes = [BoundingBox(3.0, -1.0, 5.0, 1.0), BoundingBox(71.0, -1.0, 78.0, 1.0)]
    cost = sqlgate.query_cost(spark.read.parquet(str(tmp_path)).where(intersects_any(boxes)).select("id")).first()
    assert (cost["row_groups_read"], cost["row_groups"]) == (2, 10)


@pytest.mark.parametrize("folder", ["plain", "with space", "per%20cent", "br[ack]ets {x}", "ünï"])
def test_single_file_reports_in_any_folder(spark, tmp_path, folder):
    rows = [{"name": "n" * (k % 5), "bbox": {"xmin": float(k), "xmax": float(k), "ymin": 0.0, "ymax": 0.0}} for k in range(50)]
    (tmp_path / folder).mkdir()
    pq.write_table(pa.Table.from_pylist(rows), tmp_path / folder / "part one.parquet")
    path = path_of(f"{tmp_path}/{folder.replace('%', '%25')}")
    report = pushdown_report(spark, path, BoundingBox(10.0, -1.0, 19.0, 1.0), "name").first()
    assert (report["mode"], report["matches"]) == ("single_file", 10)


def test_nearest_refuses_what_is_not_a_point(spark):
    from tessera.functions import geometry as geo

    line = bytes(geo.to_wkb(geo.from_wkt("LINESTRING (0 0, 0.001 0.001)")))
    df = spark.createDataFrame([(1, (0.0, 0.001, 0.0, 0.001), line)], "id int, bbox struct<xmin: double, xmax: double, ymin: double, ymax: double>, geometry binary")
    with pytest.raises(Exception, match="this takes points"):
        nearest.nearest(df, 0.0, 0.0, 5.0).collect()
    assert InvalidRequestError
