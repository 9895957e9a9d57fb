"""Spatial views over the driver's tables.

The tables carry no coordinates, so each view derives them from a key by arithmetic that
gives the same doubles in Spark SQL and in the checking engine. `point_sql` and `edge_sql`
write that arithmetic once for both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.spatial import st_geomfromtext
from tessera.sources.catalog import Catalog, Source, with_bbox

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lon_sql(key: str, step: int = 7919) -> str:
    return f"cast(({key} * {step}) % 36000 as double) / cast(100 as double) - cast(179.995 as double)"


def lat_sql(key: str, step: int = 104729, span: int = 17000) -> str:
    south = span / 200 - 0.005
    return f"cast(({key} * {step}) % {span} as double) / cast(100 as double) - cast({south} as double)"


# name -> (table, select list without the coordinates, key the coordinates come from)
POINTS = {
    "places": (
        "customer",
        "c_custkey AS id, c_name AS name, c_mktsegment AS category, c_acctbal AS measure, "
        "cast((c_custkey % 10) + 1 as double) / cast(10 as double) AS confidence",
        "c_custkey",
    ),
    "visits": (
        "orders",
        "o_orderkey AS id, o_orderpriority AS category, o_orderstatus AS status, o_totalprice AS measure",
        "o_orderkey",
    ),
    "parcels": (
        "lineitem",
        "l_orderkey * 8 + l_linenumber AS id, l_returnflag AS category, l_extendedprice AS measure, "
        "l_quantity AS quantity",
        "(l_orderkey * 8 + l_linenumber)",
    ),
}


def point_sql(view: str, span: int = 17000, text: str = "varchar") -> str:
    """SELECT for a point view with ``lon`` and ``lat``, valid in both engines."""
    source, columns, key = POINTS[view]
    return f"SELECT {columns}, {lon_sql(key)} AS lon, {lat_sql(key, span=span)} AS lat FROM {source}"


def points(spark: SparkSession, sf_dir: str, view: str, span: int = 17000) -> DataFrame:
    source, columns, key = POINTS[view]
    selected = table(spark, sf_dir, source).selectExpr(
        *_split(columns), f"{lon_sql(key)} AS lon", f"{lat_sql(key, span=span)} AS lat"
    )
    return with_bbox(selected)


def _split(columns: str) -> list[str]:
    return [part.strip() for part in columns.split(", ")]


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as places, in the nested layout the datasets have."""
    flat = points(spark, sf_dir, "places")
    return flat.select(
        "id",
        F.struct(F.col("name").alias("primary")).alias("names"),
        F.struct(F.col("category").alias("primary")).alias("categories"),
        "confidence",
        "measure",
        F.array(
            F.struct(F.concat(F.lit("Street "), F.col("id").cast("string")).alias("freeform"), F.lit("XX").alias("country"))
        ).alias("addresses"),
        "lon",
        "lat",
        "bbox",
    )


# -- polygons -------------------------------------------------------------------------
# name -> (table, polygon name, subtype, x of the origin, y of the origin, corner offsets)

POLYGONS = {
    "areas": (
        "nation",
        "n_name",
        "n_regionkey",
        "-180 + 72 * (n_nationkey % 5)",
        "-85 + 34 * cast(floor(n_nationkey / 5) as int)",
        [(0, 0), (72, 0), (72, 34), (36, 10), (0, 34)],
    ),
    "zones": (
        "supplier",
        "s_name",
        "s_nationkey",
        "cast(-170 + (s_suppkey * 37) % 330 as int)",
        "cast(-80 + (s_suppkey * 53) % 150 as int)",
        [(0, 3), (4, 0), (9, 2), (7, 5), (10, 9), (3, 8)],
    ),
    # Shifted off whole degrees, so that no side or corner touches a side of an area.
    "plots": (
        "supplier",
        "s_name",
        "s_nationkey",
        "cast(cast(-170 + (s_suppkey * 37) % 330 as int) + 0.37 as decimal(9, 2))",
        "cast(cast(-80 + (s_suppkey * 53) % 150 as int) + 0.21 as decimal(9, 2))",
        [(0, 0), (4, 1), (6, 5), (1, 4)],
    ),
}


def edge_sql(view: str) -> str:
    """SELECT with one row per polygon side: name, subtype, ends and envelope."""
    source, name, subtype, x, y, corners = POLYGONS[view]
    sides = ", ".join(
        f"({ax}, {ay}, {bx}, {by})" for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1])
    )
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return (
        f"SELECT {name} AS polygon_name, cast({subtype} as varchar) AS polygon_subtype, "
        f"cast({x} + s.x1 as double) AS x1, cast({y} + s.y1 as double) AS y1, "
        f"cast({x} + s.x2 as double) AS x2, cast({y} + s.y2 as double) AS y2, "
        f"cast({x} + {min(xs)} as double) AS xmin, cast({x} + {max(xs)} as double) AS xmax, "
        f"cast({y} + {min(ys)} as double) AS ymin, cast({y} + {max(ys)} as double) AS ymax "
        f"FROM {source}, (VALUES {sides}) s(x1, y1, x2, y2)"
    )


def polygons(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    source, name, subtype, x, y, corners = POLYGONS[view]
    origin = table(spark, sf_dir, source).selectExpr(
        f"{name} AS name", f"cast({subtype} as string) AS subtype", f"{x} AS x0", f"{y} AS y0"
    )
    ring = F.concat_ws(
        ", ",
        *(
            F.concat_ws(" ", F.col("x0") + F.lit(dx), F.col("y0") + F.lit(dy))
            for dx, dy in [*corners, corners[0]]
        ),
    )
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]

    def corner(axis: str, offset: int):
        return (F.col(axis) + F.lit(offset)).cast("double")

    return origin.select(
        F.struct(F.col("name").alias("primary")).alias("names"),
        "subtype",
        F.struct(
            corner("x0", min(xs)).alias("xmin"),
            corner("x0", max(xs)).alias("xmax"),
            corner("y0", min(ys)).alias("ymin"),
            corner("y0", max(ys)).alias("ymax"),
        ).alias("bbox"),
        st_geomfromtext(F.concat(F.lit("POLYGON (("), ring, F.lit("))"))).alias("geometry"),
    )


def catalog(sf_dir: str) -> Catalog:
    """Every view as a dataset; ``geometry_column=None`` says the bbox is the position."""
    point_views = [
        Source(
            name="places",
            view=lambda spark: places(spark, sf_dir),
            geometry_column=None,
            category_column="categories.primary",
            confidence_column="confidence",
            default_columns=("id", "names.primary AS name", "categories.primary AS category", "confidence"),
        ),
        Source(
            name="visits",
            view=lambda spark: points(spark, sf_dir, "visits"),
            geometry_column=None,
            name_column=None,
            category_column="category",
        ),
        Source(
            name="parcels",
            view=lambda spark: points(spark, sf_dir, "parcels"),
            geometry_column=None,
            name_column=None,
            category_column="category",
        ),
    ]
    polygon_views = [
        Source(
            name=name,
            view=lambda spark, name=name: polygons(spark, sf_dir, name),
            category_column="subtype",
            polygonal=True,
        )
        for name in POLYGONS
    ]
    plain = [
        Source(name=name, view=lambda spark, name=name: table(spark, sf_dir, name)) for name in TABLES
    ]
    return Catalog.of("driver", *point_views, *polygon_views, *plain)
