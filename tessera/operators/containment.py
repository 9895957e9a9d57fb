"""Points in polygons, as an equi-join on grid tiles.

Polygons become rows of a tile table (`tessera.functions.tiles`), points look their tile
up, and the few edges stored with the tile decide. Nothing is compared outside its tile,
so there is neither a nested-loop join nor an all-pairs step, and a point in a tile that is
wholly inside a polygon needs no test at all.

Polygons of equal geometry are one shape: it is cut once, its tiles carry a number instead of
names, and names come back after the test, to counts per shape or to the pairs.

The tile table is staged, so its size is known. While it is small it is broadcast and the
points are never shuffled. Beyond that equal points are merged, both sides are shuffled by tile,
and a tile with too many candidate pairs is split in two directions, so that neither many points
nor many polygons in one tile end up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import InvalidRequestError
from tessera.functions import geometry as geo
from tessera.functions.boxes import BoundingBox
from tessera.functions.paths import column_path, projection
from tessera.functions.spatial import wkb_xy
from tessera.functions.tiles import (
    EDGES_PER_ROW,
    TILE_FIELDS,
    contained_in_tiles,
    covered_tiles,
    crossings,
    cut_batches,
    tile_key,
)
from tessera.operators.aggregate import top, within
from tessera.plans.staging import broadcast_if, measured, stage

# In-memory bytes of the tile table up to which it is broadcast.
BROADCAST_BYTES = 128 << 20
# In-memory bytes of one row of the list of tiles that are split.
HOT_ROW_BYTES = 64
# Candidate pairs (points times polygons) of one tile up to which one task handles it ...
TILE_PAIRS = 20_000_000
# ... and polygon rows per task in a tile that is split.
TILE_POLYGONS = 10_000
# Rows that one merged row becomes at a time.
COPIES_AT_ONCE = 4096


def tile_table(
    polygons: DataFrame,
    keep: Sequence[Column] = (),
    geometry: str = "geometry",
    edges_per_row: int = EDGES_PER_ROW,
    box: BoundingBox | None = None,
) -> DataFrame:
    """The tiles of a polygon table: the kept columns, ``polygon_id``, the tile and edges.

    One pass over the polygons, no shuffle. With a `box`, only tiles at or near it: a
    country's polygon costs a city-sized question a few tiles.
    """
    source = polygons.select(
        *keep,
        F.monotonically_increasing_id().alias("polygon_id"),
        F.col(geometry).alias("__geometry"),
    )
    carried = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__geometry"
    )
    return source.mapInArrow(lambda it: cut_batches(it, "__geometry", edges_per_row, box), f"{carried}, {TILE_FIELDS}")


def with_coordinates(
    points: DataFrame, bbox: str = "bbox", geometry: str | None = "geometry"
) -> DataFrame:
    """Adds ``__x`` and ``__y``: exact from the geometry, or from the bbox without one.

    Rows without finite coordinates are left out; they are inside nothing.
    """
    if geometry:
        points = points.withColumn("__xy", wkb_xy(F.col(geometry)))
        x, y = F.col("__xy.x"), F.col("__xy.y")
    else:
        x, y = F.col(f"{bbox}.xmin"), F.col(f"{bbox}.ymin")
    located = points.select("*", x.cast("double").alias("__x"), y.cast("double").alias("__y"))
    infinite = F.lit(float("inf"))
    return located.where((F.abs("__x") < infinite) & (F.abs("__y") < infinite))


@F.arrow_udf(T.BooleanType())
def _inside_tile(x: pa.Array, y: pa.Array, edges: pa.Array) -> pa.Array:
    """Whether a point is inside, from all the edges of its tile; no edge means inside."""
    crossed, touched = crossings(np.asarray(x), np.asarray(y), edges)
    whole = np.diff(np.asarray(edges.offsets)) == 0
    return pa.array(whole | ((crossed % 2 == 1) & (touched == 0)))


@F.arrow_udf(T.StructType([T.StructField("crossed", T.LongType()), T.StructField("touched", T.LongType())]))
def _crossings(x: pa.Array, y: pa.Array, edges: pa.Array) -> pa.Array:
    """What one row contributes for a tile that is spread over several rows."""
    crossed, touched = crossings(np.asarray(x), np.asarray(y), edges)
    return pa.StructArray.from_arrays([pa.array(crossed), pa.array(touched)], ["crossed", "touched"])


def _candidates(
    base: DataFrame,
    tiles: DataFrame,
    facts: dict,
    extra_per_level,
    broadcast_bytes: int,
    tile_pairs: int,
) -> DataFrame:
    """Every point with the rows of its tile, at each level the polygons use."""
    x, y = F.col("__x"), F.col("__y")
    per_level = [
        F.struct(tile_key(x, y, level).alias("tile"), *extra_per_level(level)) for level in facts["levels"]
    ]
    if not per_level:
        per_level = [F.struct(F.lit(None).cast("bigint").alias("tile"), *extra_per_level(0))]
    keyed = base.withColumn("__at", F.explode(F.array(*per_level))).select("*", "__at.*").drop("__at")
    if facts["size"] <= broadcast_bytes:
        return keyed.join(broadcast_if(tiles, facts["size"], broadcast_bytes), "tile")
    columns = [c for c in keyed.columns if c not in ("tile", "weight")]
    return _shuffled_join(keyed, tiles, columns, tile_pairs)


def _tile_facts(tiles: DataFrame, kept: Sequence[str] = ()) -> dict:
    """What the tile table holds; its in-memory size counts the kept columns, which every tile repeats."""
    carried = F.octet_length(F.to_json(F.struct(*kept))) if kept else F.lit(0)
    facts = measured(
        tiles,
        carried=F.coalesce(F.sum(carried), F.lit(0)),
        rows=F.count(F.lit(1)),
        edges=F.coalesce(F.sum(F.size("edges")) / 4, F.lit(0)),
        chunks=F.coalesce(F.max("chunks"), F.lit(1)),
        levels=F.sort_array(F.collect_set("level")),
    )
    return facts | {"size": 160 * facts["rows"] + 40 * facts["edges"] + facts["carried"]}


def contained_pairs(
    points: DataFrame,
    tiles: DataFrame,
    point_columns: Sequence[str] = (),
    polygon_columns: Sequence[str] = (),
    broadcast_bytes: int = BROADCAST_BYTES,
    tile_pairs: int = TILE_PAIRS,
) -> DataFrame:
    """``point_columns, polygon_columns``: one row for every polygon and point inside it.

    `points` has ``__x`` and ``__y`` (`with_coordinates`), `tiles` is a **staged** tile
    table. Points on a polygon's boundary are not inside it. Equal points that were merged
    on the way to a hot tile become rows of their own again, so no limit changes the result.
    """
    pairs = _weighted_pairs(points, tiles, point_columns, polygon_columns, broadcast_bytes, tile_pairs)
    return _rows_again(pairs, [*point_columns, *polygon_columns])


def _rows_again(pairs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each row ``weight`` times, in lists of bounded length."""
    at_once = F.lit(COPIES_AT_ONCE).cast("bigint")
    blocks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("weight") - 1) / at_once).cast("bigint"))
    dealt = pairs.select(*columns, "weight", F.explode(blocks).alias("__block"))
    here = F.least(at_once, F.col("weight") - F.col("__block") * at_once)
    return dealt.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), here))).select(*columns)


def _by_shape(
    polygons: DataFrame, keep: Sequence[Column], names: Sequence[str], geometry: str, box: BoundingBox | None
) -> tuple[DataFrame, DataFrame, dict]:
    """Tiles of the distinct geometries (by ``__shape``), the polygons that have each of them, and their measure.

    The polygons are rows of ``__shape``, the kept columns and ``copies``, the number of equal ones.
    """
    named = polygons.select(*keep, F.col(geometry).alias("__geometry")).where(F.col("__geometry").isNotNull())
    # Staged, so that the number given here is the same wherever the shapes are used.
    shapes = stage(
        named.select("__geometry").distinct().withColumn("__shape", F.monotonically_increasing_id()), "shapes"
    )
    tiles = stage(tile_table(shapes, [F.col("__shape")], "__geometry", box=box), "tiles")
    same = named.groupBy("__geometry", *names).agg(F.count(F.lit(1)).alias("copies"))
    members = stage(same.join(shapes, "__geometry").select("__shape", *names, "copies"), "members")
    facts = measured(
        members,
        rows=F.count(F.lit(1)),
        carried=F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*names)))), F.lit(0)),
        shapes=F.count_distinct("__shape"),
    )
    return tiles, members, facts | {"size": 64 * facts["rows"] + facts["carried"]}


def _weighted_pairs(
    points: DataFrame,
    tiles: DataFrame,
    point_columns: Sequence[str],
    polygon_columns: Sequence[str],
    broadcast_bytes: int,
    tile_pairs: int,
) -> DataFrame:
    """`contained_pairs` with equal points merged where that saves work: their number is ``weight``."""
    facts = _tile_facts(tiles, polygon_columns)
    split = facts["chunks"] > 1
    base = points.select(*point_columns, "__x", "__y", F.lit(1).cast("bigint").alias("weight"))
    if facts["size"] > broadcast_bytes:
        base = base.groupBy(*point_columns, "__x", "__y").agg(F.sum("weight").alias("weight"))
    joined = _candidates(base, tiles, facts, lambda level: [], broadcast_bytes, tile_pairs)
    x, y = F.col("__x"), F.col("__y")
    kept = [*point_columns, *polygon_columns]
    whole = joined.where(F.col("chunks") == 1) if split else joined
    whole = whole.where(_inside_tile(x, y, F.col("edges"))).select(*kept, "weight")
    if not split:
        return whole
    # A tile over several rows: every point meets each of them, so crossings are added up
    # per place. Equal points (m of them) meet each row m times.
    c, w = F.col("__c"), F.col("weight")
    spread = (
        joined.where(F.col("chunks") > 1)
        .withColumn("__c", _crossings(x, y, F.col("edges")))
        .groupBy("__x", "__y", "polygon_id", *kept)
        .agg(
            F.sum(c.getField("crossed") * w).alias("__crossed"),
            F.max(c.getField("touched")).alias("__touched"),
            (F.sum(w) / F.first("chunks")).cast("bigint").alias("weight"),
        )
        .where((F.col("__touched") == 0) & (F.col("__crossed") / F.col("weight") % 2 == 1))
    )
    return whole.unionByName(spread.select(*kept, "weight"))


@F.arrow_udf(
    T.StructType(
        [T.StructField(n, T.DoubleType()) for n in ("x", "y", "xmin", "ymin", "xmax", "ymax")]
    )
)
def _outline(wkb: pa.Array) -> pa.Array:
    """First vertex and envelope of any geometry; NULL for an empty one."""
    rows = []
    for value in wkb.to_pylist():
        xy = geo.vertices(geo.from_wkb(value)) if value is not None else ()
        if not len(xy):
            rows.append(None)
            continue
        (x0, y0), (x1, y1) = xy.min(axis=0), xy.max(axis=0)
        rows.append({"x": xy[0, 0], "y": xy[0, 1], "xmin": x0, "ymin": y0, "xmax": x1, "ymax": y1})
    return pa.array(rows, pa.struct([(n, pa.float64()) for n in ("x", "y", "xmin", "ymin", "xmax", "ymax")]))


# As for `wkb_xy`: decode once, whatever filters follow.
_outline = _outline.asNondeterministic()


@F.arrow_udf(T.BooleanType())
def _in_or_on(x: pa.Array, y: pa.Array, edges: pa.Array) -> pa.Array:
    crossed, touched = crossings(np.asarray(x), np.asarray(y), edges)
    whole = np.diff(np.asarray(edges.offsets)) == 0
    return pa.array(whole | (crossed % 2 == 1) | (touched > 0))


@F.arrow_udf(T.BooleanType())
def _contained_locally(wkb: pa.Array, level: pa.Array, around: pa.Array) -> pa.Array:
    return pa.array(
        [
            contained_in_tiles(geo.from_wkb(w), lv, [t["tile"] for t in near], [t["edges"] for t in near])
            for w, lv, near in zip(wkb.to_pylist(), level.to_pylist(), around.to_pylist())
        ],
        pa.bool_(),
    )


def areas_in_polygons(
    areas: DataFrame,
    tiles: DataFrame,
    polygon_columns: Sequence[str] = (),
    geometry: str = "geometry",
    broadcast_bytes: int = BROADCAST_BYTES,
    tile_pairs: int = TILE_PAIRS,
) -> DataFrame:
    """``polygon_columns, weight`` for every polygon and geometry of any kind inside it.

    A geometry is looked up by its first vertex. One whose rectangle stays in a tile that
    is wholly inside the polygon is contained without a test. For the others, whose
    rectangle must lie in the polygon's (``__env`` of the staged tiles), the tiles under
    their rectangle are fetched and the geometry is tested against those edges alone; the
    number of such tiles is bounded by the polygon's own.
    """
    facts = _tile_facts(tiles, [*polygon_columns, "__env"])
    outlined = areas.select(F.col(geometry).alias("__wkb"), _outline(F.col(geometry)).alias("__o"))
    base = outlined.where(F.col("__o.x").isNotNull()).select(
        "__wkb", "__o", F.col("__o.x").alias("__x"), F.col("__o.y").alias("__y"), F.lit(1).cast("bigint").alias("weight")
    )

    def corners(level: int) -> list[Column]:
        return [
            tile_key(F.col("__o.xmin"), F.col("__o.ymin"), level).alias("__low"),
            tile_key(F.col("__o.xmax"), F.col("__o.ymax"), level).alias("__high"),
        ]

    found = _candidates(base, tiles, facts, corners, broadcast_bytes, tile_pairs)
    found = found.where(F.col("chunk") == 0)
    plain = F.size("edges") == 0
    one_tile = (F.col("__low") == F.col("tile")) & (F.col("__high") == F.col("tile"))
    sure = found.where(plain & one_tile).select(*polygon_columns, "weight")
    fits = (
        (F.col("__env.xmin") <= F.col("__o.xmin"))
        & (F.col("__env.ymin") <= F.col("__o.ymin"))
        & (F.col("__env.xmax") >= F.col("__o.xmax"))
        & (F.col("__env.ymax") >= F.col("__o.ymax"))
    )
    near = found.where(~(plain & one_tile) & fits)
    near = near.where((F.col("chunks") > 1) | _in_or_on(F.col("__x"), F.col("__y"), F.col("edges")))
    # Staged, so that the row number given here is the same wherever the rows are used.
    open_cases = stage(
        near.select(
            "__wkb", "polygon_id", "level", "__low", "__high", "weight", *polygon_columns,
            F.monotonically_increasing_id().alias("__case"),
        ),
        "open-cases",
    )
    under = open_cases.select(
        "__case", "weight", "polygon_id", F.explode(covered_tiles(F.col("__low"), F.col("__high"))).alias("tile")
    )
    nearby = tiles.select("polygon_id", "tile", "edges")
    keys = ["polygon_id", "tile"]
    if facts["size"] <= broadcast_bytes:
        fetched = under.join(broadcast_if(nearby, facts["size"], broadcast_bytes), keys)
    else:
        fetched = _shuffled_join(under, nearby, ["__case"], tile_pairs, keys)
    around = fetched.groupBy("__case").agg(F.collect_list(F.struct("tile", "edges")).alias("around"))
    tested = open_cases.join(around, "__case").where(
        _contained_locally(F.col("__wkb"), F.col("level"), F.col("around"))
    )
    return sure.unionByName(tested.select(*polygon_columns, "weight"))


def _shuffled_join(
    keyed: DataFrame,
    tiles: DataFrame,
    columns: Sequence[str],
    tile_pairs: int,
    keys: Sequence[str] = ("tile",),
) -> DataFrame:
    """Both sides by tile, with the tiles that mean too many candidate pairs split.

    Every tile beyond the threshold is split, however many there are; the list of them is
    broadcast only if its measured size allows. In a hot tile equal points
    are first merged (one place can hold any number of them). The points then go to
    ``point_parts`` groups and the polygons to ``polygon_parts`` groups, by hashes of their
    content, which a re-run task reproduces; each pair of groups meets in one task.
    """
    keys = list(keys)
    # The tile table may compress to less than Spark's own broadcast threshold.
    tiles = tiles.hint("merge")
    held = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("held"))
    stacked = tiles.groupBy(*keys).agg(F.count(F.lit(1)).alias("stacked"))
    load = stage(
        held.join(stacked, keys).withColumn("pairs", F.col("held").cast("double") * F.col("stacked")), "tile-load"
    )
    threshold = float(tile_pairs)
    n_hot = measured(load, hot=F.count_if(F.col("pairs") > threshold))["hot"]
    if not n_hot:
        return keyed.join(tiles, keys)
    polygon_parts = F.ceil(F.col("stacked") / F.lit(TILE_POLYGONS))
    per_group = F.col("held") * F.col("stacked") / polygon_parts
    hot = load.where(F.col("pairs") > threshold).select(
        *keys,
        F.ceil(per_group / F.lit(threshold)).cast("int").alias("point_parts"),
        polygon_parts.cast("int").alias("polygon_parts"),
    )
    hot = broadcast_if(hot, HOT_ROW_BYTES * n_hot, BROADCAST_BYTES)
    cold = keyed.join(hot, keys, "left_anti").join(tiles, keys)

    def group_of(content: Sequence[str], parts: str) -> Column:
        return F.pmod(F.xxhash64(*content), F.col(parts).cast("bigint")).cast("int")

    def all_groups(parts: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))

    merged = keyed.join(hot, keys, "left_semi").groupBy(*keys, *columns).agg(F.sum("weight").alias("weight"))
    spread = (
        merged.join(hot, keys)
        .withColumn("point_part", group_of(columns, "point_parts"))
        .withColumn("polygon_part", all_groups("polygon_parts"))
        .drop("point_parts", "polygon_parts")
    )
    copies = (
        tiles.join(hot, keys)
        .withColumn("polygon_part", group_of(["polygon_id"], "polygon_parts"))
        .withColumn("point_part", all_groups("point_parts"))
        .drop("point_parts", "polygon_parts")
    )
    split = [*keys, "point_part", "polygon_part"]
    heated = spread.join(copies.hint("merge"), split).drop("point_part", "polygon_part")
    return cold.unionByName(heated)


def points_in_polygons(
    points: DataFrame,
    polygons: DataFrame,
    box: BoundingBox | None = None,
    *,
    point_columns: Sequence[str],
    polygon_columns: Sequence[str],
    point_geometry: str | None = "geometry",
    polygon_geometry: str = "geometry",
    point_bbox: str = "bbox",
    polygon_bbox: str = "bbox",
    broadcast_bytes: int = BROADCAST_BYTES,
    tile_pairs: int = TILE_PAIRS,
) -> DataFrame:
    """The containment join itself: every (point, polygon around it).

    `polygon_columns` are ``path AS alias`` items. Every pair is a row, at every size.
    """
    keep = projection(polygons, None, tuple(polygon_columns))
    names = [item.partition(" AS ")[2] or item for item in polygon_columns]
    tiles, members, facts = _by_shape(within(polygons, box, polygon_bbox), keep, names, polygon_geometry, box)
    located = with_coordinates(within(points, box, point_bbox), point_bbox, point_geometry)
    limits = {"broadcast_bytes": broadcast_bytes, "tile_pairs": tile_pairs}
    columns = [*point_columns, *names]
    if facts["size"] > BROADCAST_BYTES and facts["rows"] < 2 * facts["shapes"]:
        # Mostly shapes of one polygon: names travel with the tiles, and the pairs are not moved again.
        tiles = stage(tiles.join(members, "__shape"), "named-tiles")
        pairs = _weighted_pairs(located, tiles, point_columns, [*names, "copies"], **limits)
    else:
        found = _weighted_pairs(located, tiles, point_columns, ["__shape"], **limits)
        pairs = found.join(broadcast_if(members, facts["size"], BROADCAST_BYTES), "__shape")
    return _rows_again(pairs.withColumn("weight", F.col("weight") * F.col("copies")), columns)


def count_in_polygons(
    points: DataFrame,
    polygons: DataFrame,
    box: BoundingBox | None = None,
    *,
    subtype: str | None = None,
    k: int | None = None,
    name_column: str = "names.primary",
    subtype_column: str | None = None,
    point_geometry: str | None = "geometry",
    polygon_geometry: str = "geometry",
    point_bbox: str = "bbox",
    polygon_bbox: str = "bbox",
    areal: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    tile_pairs: int = TILE_PAIRS,
) -> DataFrame:
    """``(polygon_name, polygon_subtype, feature_count)``: points inside each polygon.

    With `areal` the counted features are lines or areas and must lie wholly inside. The
    rectangle prunes both scans. Polygons of one name and subtype are counted
    together, polygons without a point are absent.
    """
    areas = within(polygons, box, polygon_bbox)
    if subtype:
        if subtype_column is None:
            raise InvalidRequestError("the polygon dataset has no subtype column to filter on")
        areas = areas.where(column_path(subtype_column) == F.lit(subtype))
    keep = [
        column_path(name_column).alias("polygon_name"),
        (column_path(subtype_column) if subtype_column else F.lit(None).cast("string")).alias(
            "polygon_subtype"
        ),
    ]
    names = ["polygon_name", "polygon_subtype"]
    if areal:
        keep.append(_outline(F.col(polygon_geometry)).alias("__env"))
    limits = {"broadcast_bytes": broadcast_bytes, "tile_pairs": tile_pairs}
    chosen = within(points, box, point_bbox)
    if areal:
        tiles = stage(tile_table(areas, keep, polygon_geometry), "tiles")
        inside = areas_in_polygons(chosen, tiles, names, point_geometry, **limits)
    else:
        tiles, members, facts = _by_shape(areas, keep, names, polygon_geometry, box)
        located = with_coordinates(chosen, point_bbox, point_geometry)
        found = _weighted_pairs(located, tiles, (), ["__shape"], **limits)
        held = found.groupBy("__shape").agg(F.sum("weight").alias("weight"))
        inside = held.join(broadcast_if(members, facts["size"], BROADCAST_BYTES), "__shape").withColumn(
            "weight", F.col("weight") * F.col("copies")
        )
    counts = inside.groupBy("polygon_name", "polygon_subtype").agg(F.sum("weight").alias("feature_count"))
    return top(
        counts,
        k,
        F.col("feature_count").desc(),
        F.col("polygon_name").asc_nulls_last(),
        F.col("polygon_subtype").asc_nulls_last(),
    )
