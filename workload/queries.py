"""One registered query per operator: the Spark side, and its SQL twin in `oracles`."""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.boxes import BoundingBox
from tessera.operators import aggregate, containment, features, nearest, statistics
from tessera.plans.pushdown import pushdown_report
from tessera.plans.sqlgate import run_sql
from tessera.plans.staging import checkpoint_dir, stage
from tessera.sources import footers
from tessera.sources.catalog import Catalog, Source, schema_with_roles
from tessera.sources.footerstore import kept_footers
from workload import sqlsuite
from workload.views import catalog, places, points, polygons, table

Query = Callable[[SparkSession, str], DataFrame]


def _coast(corners: int) -> str:
    """A detailed outline around the middle of the map, by a rule."""
    ring = []
    for k in range(corners):
        turn = 2 * math.pi * k / corners
        reach = 0.62 + 0.2 * math.sin(7 * turn) + 0.1 * math.sin(61 * turn) + 0.03 * (k * 7919 % 101) / 101
        ring.append(f"{round(150 * reach * math.cos(turn), 4)} {round(75 * reach * math.sin(turn), 4)}")
    return f"POLYGON (({', '.join([*ring, ring[0]])}))"


DETAILED = _coast(8000)
BOX = BoundingBox(-60.0, -30.0, 75.5, 48.25)
SMALL = BoundingBox(2.2, 48.0, 9.5, 55.0)
SEVERAL = [BoundingBox(-120.0, 30.0, -70.0, 50.0), BoundingBox(0.0, 40.0, 20.0, 60.0), BoundingBox(10.0, 50.0, 90.0, 70.0)]
NOTCHED = "POLYGON ((-100.5 -50.25, 80.75 -40.5, 120.25 60.5, 10.5 5.25, -90.25 70.5, -100.5 -50.25), (0.5 -30.5, 20.5 -30.5, 20.5 -10.5, 0.5 -10.5, 0.5 -30.5))"
LATTICE = "POLYGON ((-90 -40, 60 -40, 60 35, 0 0, -90 45, -90 -40))"
SEVERAL_SHAPES = "MULTIPOLYGON (((-170 -60, -100 -60, -100 0, -170 -60)), ((20 10, 90 10, 90 60, 20 10)))"


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(F.col(c), digits).alias(c) if c in names else F.col(c) for c in df.columns))


def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders on whole degrees, so that many lie exactly on polygon sides and corners."""
    from tessera.sources.catalog import with_bbox

    return with_bbox(
        table(spark, sf_dir, "orders").selectExpr(
            "o_orderkey AS id",
            "cast((o_orderkey * 7919) % 360 as double) - cast(180 as double) AS lon",
            "cast((o_orderkey * 104729) % 170 as double) - cast(85 as double) AS lat",
        )
    )


PLACE_ROLES = {
    "category_column": "categories.primary",
    "name_column": "names.primary",
    "confidence_column": "confidence",
    "geometry": None,
}


def _place_filter(columns=("id", "confidence"), **arguments) -> Query:
    return lambda spark, sf: features.spatial_filter(
        places(spark, sf), columns=list(columns), **PLACE_ROLES, **arguments
    ).drop(features.GEOMETRY)


def _grouped(aggregate_name: str, measure: str | None) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        groups = aggregate.group_aggregate(
            points(spark, sf, "parcels"), "category", aggregate_name, measure, BOX
        )
        if aggregate_name in ("sum", "avg"):
            groups = rounded(groups, "value", digits=2 if aggregate_name == "sum" else 6)
        return groups

    return query


def _nearest(lon: float, lat: float, radius: float, view: str = "visits", span: int = 17000, k: int | None = 25) -> Query:
    return lambda spark, sf: nearest.nearest(
        points(spark, sf, view, span), lon, lat, radius, geometry=None, k=k, columns=["id", "category"]
    )


def _nearest_wkb(spark: SparkSession, sf: str) -> DataFrame:
    """Coordinates read from a WKB geometry column instead of the bbox."""
    from tessera.functions.spatial import st_point

    located = points(spark, sf, "visits").withColumn("geometry", st_point(F.col("lon"), F.col("lat")))
    return nearest.nearest(located, 2.35, 48.85, 400.0, k=25, columns=["id", "category"])


def _pip(view: str, areas: str, **arguments) -> Query:
    return lambda spark, sf: containment.count_in_polygons(
        points(spark, sf, view),
        polygons(spark, sf, areas),
        point_geometry=None,
        subtype_column="subtype",
        **arguments,
    )


def _pip_lattice(spark: SparkSession, sf: str) -> DataFrame:
    return containment.count_in_polygons(
        lattice(spark, sf), polygons(spark, sf, "areas"), point_geometry=None, subtype_column="subtype"
    )


def _pip_wkb(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.functions.spatial import st_point

    located = points(spark, sf, "visits").withColumn("geometry", st_point(F.col("lon"), F.col("lat")))
    return containment.count_in_polygons(located, polygons(spark, sf, "areas"), subtype_column="subtype")


def _pip_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return containment.points_in_polygons(
        points(spark, sf, "visits"),
        polygons(spark, sf, "zones"),
        point_columns=["id"],
        polygon_columns=["names.primary AS polygon_name"],
        point_geometry=None,
    )


def _pip_pairs_hot(spark: SparkSession, sf: str) -> DataFrame:
    """Every point three times under labels that many points share, in tiles that are all split."""
    visits = points(spark, sf, "visits").withColumn("label", (F.col("id") % 5).cast("bigint"))
    return containment.points_in_polygons(
        visits.withColumn("copy", F.explode(F.array(*map(F.lit, range(3))))).drop("copy"),
        polygons(spark, sf, "zones"),
        point_columns=["label"],
        polygon_columns=["names.primary AS polygon_name"],
        point_geometry=None,
        broadcast_bytes=0,
        tile_pairs=10,
    )


def _file_names(spark: SparkSession, sf: str) -> DataFrame:
    named = features.with_file_name(table(spark, sf, "customer"))
    return named.groupBy(F.regexp_extract("filename", r"([a-z]+\.parquet)", 1).alias("file")).agg(F.count("*").alias("row_count"))


def _geojson_geometry(spark: SparkSession, sf: str) -> DataFrame:
    """Points through binary geometry and back out of its GeoJSON text."""
    from tessera.functions.spatial import st_asgeojson, st_point

    text = st_asgeojson(st_point(F.col("lon"), F.col("lat")))
    read = points(spark, sf, "visits").select("id", F.from_json(text, "type string, coordinates array<double>").alias("g"))
    return read.select("id", "g.type", F.col("g.coordinates")[0].alias("lon"), F.col("g.coordinates")[1].alias("lat"))


def _orders_footprint(spark: SparkSession, sf: str) -> DataFrame:
    whole = footers.footprint(footers.footers(spark, f"{sf}/orders.parquet"))
    return whole.select("row_count", "files", (F.col("bytes") > 0).alias("has_bytes"))


def _wkt(wkt: str, view: str = "visits") -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        df = lattice(spark, sf) if view == "lattice" else points(spark, sf, view)
        return features.spatial_filter(df, wkt=wkt, columns=["id"], geometry=None).select("id")

    return query


def _polygon_intersects(spark: SparkSession, sf: str) -> DataFrame:
    """A literal shape against polygon geometries."""
    return features.spatial_filter(
        polygons(spark, sf, "zones"), wkt=NOTCHED, columns=["names.primary"]
    ).select(F.col("`names.primary`").alias("polygon_name"))


_WIDE_ZONES = "(p.id + cast(z.subtype AS int)) % 3 <> 0"


def _sql_join_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """A spatial join in SQL with conditions on either side and on both, and a star."""
    text = (
        "WITH hits AS (SELECT p.*, z.names.primary AS polygon_name FROM visits p, zones AS z WHERE st_contains(z.geometry, "
        f"st_point(p.lon, p.lat)) AND z.subtype >= '2' AND p.measure > 50000 AND {_WIDE_ZONES}) SELECT id, polygon_name, lon, category FROM hits"
    )
    return run_sql(spark, catalog(sf), text, max_rows=None)


def _with_lattice(spark: SparkSession, sf: str) -> Catalog:
    own = Source(name="lattice", view=lambda spark: lattice(spark, sf), geometry_column=None, name_column=None)
    return Catalog.of("driver", own, catalog(sf).get("areas"))


def _density(resolution: int, grid: str) -> Query:
    return lambda spark, sf: rounded(
        aggregate.cell_density(points(spark, sf, "parcels"), BOX, resolution, grid),
        "centre_lat",
        "centre_lon",
    )


def _footprint(spark: SparkSession, sf: str) -> DataFrame:
    """Row counts of every table, from the footers alone."""
    wanted = F.regexp_extract("file", r"/([a-z]+)\.parquet(?:/[^/]*)?$", 1)
    return (
        footers.footers(spark, sf)
        .groupBy("file")
        .agg(F.first("file_rows").alias("row_count"), F.first("file_row_groups").alias("row_groups"))
        .groupBy(wanted.alias("name"))
        .agg(F.sum("row_count").alias("row_count"), F.count(F.lit(1)).alias("files"))
    )


def _footers_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Row groups by file, from a store that a second call finds complete."""
    store, path = f"{checkpoint_dir(spark)}/footers-{uuid.uuid4().hex}", _banded_parcels(spark, sf, one_file=False)
    kept_footers(spark, store, path)
    kept = kept_footers(spark, store, path).where("column = 'measure'")
    band = F.regexp_extract("file", r"band=(-?\d+)", 1).cast("int")
    return kept.groupBy(band.alias("band")).agg(
        F.sum("group_rows").alias("row_count"), F.min(F.col("min_value").cast("double")).alias("low"), F.max(F.col("max_value").cast("double")).alias("high")
    )


def _footer_bounds(spark: SparkSession, sf: str) -> DataFrame:
    wanted = ["l_quantity", "l_extendedprice", "l_discount", "l_orderkey", "l_linenumber"]
    return (
        footers.column_bounds(footers.footers(spark, f"{sf}/lineitem.parquet"))
        .where(F.col("column").isin(wanted))
        .select("column", "minimum", "maximum", "complete")
    )


def _staged_parcels(spark: SparkSession, sf: str) -> str:
    """The parcels as Parquet files of their own, range-partitioned by longitude."""
    ranged = points(spark, sf, "parcels").repartitionByRange("lon").sortWithinPartitions("lon")
    return os.path.dirname(stage(ranged.select("id", "category", "bbox"), "parcels").inputFiles()[0])


def _footer_extent(spark: SparkSession, sf: str) -> DataFrame:
    return footers.extent(footers.footers(spark, _staged_parcels(spark, sf))).drop("row_groups")


def _footer_pruning(spark: SparkSession, sf: str) -> DataFrame:
    """Row groups cannot be skipped wrongly: those kept hold at least the matching rows."""
    path = _staged_parcels(spark, sf)
    report = footers.scan_report(footers.footers(spark, path), ["id"], SMALL)
    matches = spark.read.parquet(path).where(SMALL.intersects()).agg(F.count(F.lit(1)).alias("matches"))
    return report.select(
        "rows",
        matches.scalar().alias("matches"),
        (F.col("rows_read") >= matches.scalar()).alias("keeps_matches"),
        (F.col("bytes_scanned") <= F.col("bytes_unpruned")).alias("never_more"),
    )


def _banded_parcels(spark: SparkSession, sf: str, one_file: bool = True) -> str:
    """The parcels by quarter of the longitudes: one file each, or as many as tasks read.

    Band by band, since one write of all bands would sort them in memory.
    """
    path = f"{checkpoint_dir(spark)}/bands-{uuid.uuid4().hex}"
    banded = points(spark, sf, "parcels").withColumn("band", F.floor(F.col("lon") / 90).cast("int"))
    for row in banded.select("band").distinct().collect():
        chosen = banded.where(F.col("band").eqNullSafe(row["band"])).select("id", "measure", "category", "lon", "lat", "bbox")
        (chosen.repartition(1) if one_file else chosen).write.parquet(f"{path}/band={row['band']}")
    return path


#: Either of two rectangles, but no cheap parcel; statistics decide by file.
TREE = (
    "and",
    [
        ("or", [("and", [("lon", ">", 95.0), ("lat", "<=", 10.0)]), ("and", [("lon", "<", -100.0), ("not", ("lat", ">=", -20.0))])]),
        ("not", ("measure", "<", 950.0)),
        ("id", "in", [9, 17, 1_000_000_000]),
    ],
)


def _scan_report_multi(spark: SparkSession, sf: str) -> DataFrame:
    report = footers.scan_report(footers.footers(spark, _banded_parcels(spark, sf)), ["measure"], TREE)
    return report.select("rows_read", "row_groups_read", "files_touched", "rows", "files")


def _busiest_band(spark: SparkSession, sf: str) -> DataFrame:
    found = features.busiest_file(spark.read.parquet(_banded_parcels(spark, sf)), BOX)
    return found.select(F.regexp_extract("filename", r"band=(-?\d+)", 1).cast("int").alias("band"), "matches")


def _pushdown_single(spark: SparkSession, sf: str) -> DataFrame:
    """Both sides of the comparison in a folder whose name needs decoding."""
    path = f"{checkpoint_dir(spark)}/single file {uuid.uuid4().hex}"
    points(spark, sf, "parcels").select("id", "category", "bbox").coalesce(1).write.parquet(path)
    report = pushdown_report(spark, path, SMALL, "category", "single_file")
    return report.select(
        "mode", "matches", (F.col("scan_rows_with_pushdown") <= F.col("scan_rows_without_pushdown")).alias("never_more"),
        F.col("scan_rows_without_pushdown").alias("rows"),
    )


def _geo_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The ``geo`` key of each nation's own document, as a footer would carry it."""
    crs = F.when(F.col("n_regionkey") == 0, F.lit(None)).when(
        F.col("n_regionkey") == 1, F.to_json(F.struct(F.struct(F.lit("EPSG").alias("authority"), (F.col("n_nationkey") + 4000).alias("code")).alias("id")))
    ).when(F.col("n_regionkey") == 2, F.to_json(F.struct(F.col("n_name").alias("name")))).when(F.col("n_regionkey") == 3, F.concat(F.lit('"'), "n_name", F.lit('"'))).otherwise(F.lit("{}"))
    document = F.concat(
        F.lit('{"version": "1.0.0", "primary_column": "geometry", "columns": {"geometry": {"encoding": "WKB", "geometry_types": ["Point"], "crs": '),
        F.coalesce(crs, F.lit("null")), F.lit("}}}"),
    )
    real = footers.footers(spark, f"{sf}/nation.parquet")
    held = table(spark, sf, "nation").select("n_regionkey", "n_name", document.alias("document"))
    out: DataFrame | None = None
    for region in range(5):
        first = held.where(F.col("n_regionkey") == region).agg(F.min("document").alias("document"))
        found = footers.geo_metadata(real.withColumn("geo", first.scalar()))
        found = found.select(F.lit(region).cast("bigint").alias("region"), "crs", "crs_is_default", "encoding", "geoparquet_version")
        out = found if out is None else out.unionByName(found)
    return out


def _pushdown(spark: SparkSession, sf: str) -> DataFrame:
    report = pushdown_report(spark, _staged_parcels(spark, sf), SMALL, "category", "whole_dataset")
    return report.select("mode", "matches")


def _scan_report(spark: SparkSession, sf: str) -> DataFrame:
    report = footers.scan_report(
        footers.footers(spark, f"{sf}/lineitem.parquet"),
        ["l_extendedprice"],
        [("l_quantity", "<=", 50.0), ("l_quantity", ">=", 1.0)],
    )
    return report.select("rows_read", "rows", "files", (F.col("bytes_scanned") > 0).alias("reads_something"))


def _schema_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Columns, types and roles of a table, with the values the footers count for each."""
    source = Source(name="orders", root=sf, geometry_column=None, name_column="o_orderpriority", category_column="o_orderstatus")
    held = (
        footers.footers(spark, f"{sf}/orders.parquet")
        .groupBy("column")
        .agg(F.sum("group_rows").alias("row_count"))
    )
    return schema_with_roles(table(spark, sf, "orders"), source).join(held, "column").drop("position")


def _features(spark: SparkSession, sf: str) -> DataFrame:
    chosen = features.spatial_filter(
        places(spark, sf), box=BOX, columns=["id", "names.primary", "confidence"], include_geometry=False, **PLACE_ROLES
    )
    text = features.to_features(chosen).select("feature")
    # The text is read back field by field: number formatting is not part of the check.
    pick = lambda path: F.get_json_object("feature", path)
    return text.select(
        pick("$.id").cast("bigint").alias("id"),
        pick("$.type").alias("type"),
        pick("$.geometry.type").alias("geometry_type"),
        pick("$.geometry.coordinates[0]").cast("double").alias("lon"),
        pick("$.geometry.coordinates[1]").cast("double").alias("lat"),
        F.get_json_object("feature", "$.properties['names.primary']").alias("name"),
        pick("$.properties.confidence").cast("double").alias("confidence"),
    )


def _profile_part(part: str, view: str, column: str, *round_columns: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        profile = statistics.column_stats(points(spark, sf, view), column, BOX)
        return rounded(getattr(profile, part), *round_columns)

    return query


def _run_sql(text: str) -> Query:
    return lambda spark, sf: run_sql(spark, catalog(sf), text, max_rows=None)


QUERIES: dict[str, Query] = {
    # selection
    "bbox_filter": _place_filter(("id", "measure"), box=BOX),
    "bbox_filter_multi": _place_filter(box=SEVERAL),
    "filter_category": _place_filter(box=BOX, category="BUILDING"),
    "filter_name_contains": _place_filter(box=BOX, name_contains="CUSTOMER#0000001"),
    "filter_name_wildcards": _place_filter(box=BOX, name_contains="r#_00%7"),
    "filter_min_confidence": _place_filter(box=BOX, min_confidence=0.75),
    "attribute_filters": _place_filter(box=BOX, category="MACHINERY", name_contains="customer#", min_confidence=0.4),
    "projection_nested": lambda spark, sf: features.spatial_filter(
        places(spark, sf),
        box=BOX,
        columns=["id", "names.primary", "addresses[1].freeform", "addresses[2].freeform"],
        **PLACE_ROLES,
    ).select(
        "id",
        F.col("`names.primary`").alias("name"),
        F.col("`addresses[1].freeform`").alias("street"),
        F.col("`addresses[2].freeform`").alias("missing"),
    ),
    "wkt_filter": _wkt(NOTCHED),
    "wkt_filter_boundary": _wkt(LATTICE, "lattice"),
    "wkt_filter_multipolygon": _wkt(SEVERAL_SHAPES),
    "wkt_filter_detailed": _wkt(DETAILED),
    "wkt_filter_polygons": _polygon_intersects,
    "geojson_points": _features,
    "extent_scan": lambda spark, sf: features.extent_by_scan(points(spark, sf, "parcels")),
    "read_forcing": lambda spark, sf: features.forced_read(places(spark, sf), BOX, "names.primary"),
    "busiest_file": _busiest_band,
    "preview_filtered": lambda spark, sf: features.preview(
        table(spark, sf, "customer").where("c_custkey > 100"), ["c_custkey", "c_name"], 7
    ),
    "preview_view": lambda spark, sf: features.preview(points(spark, sf, "visits").where("id > 20"), ["id", "category"], 5),
    "filter_limited": lambda spark, sf: features.spatial_filter(
        points(spark, sf, "visits"), box=BOX, columns=["id", "measure"], geometry=None, limit=1400, order_by=["id"]
    ).drop(features.GEOMETRY),
    "sql_limit": lambda spark, sf: run_sql(
        spark, catalog(sf), "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 50", max_rows=12
    ),
    "preview": lambda spark, sf: features.preview(table(spark, sf, "customer"), ["c_custkey", "c_name"], 7),
    # nearest
    "nearest_point": _nearest(2.35, 48.85, 400.0),
    "nearest_all_in_radius": _nearest(-70.25, -12.5, 350.0, "parcels", k=None),
    "nearest_pole": _nearest(30.0, 89.5, 450.0, span=18000),
    "nearest_antimeridian": _nearest(179.9, 10.0, 500.0),
    "nearest_wkb": _nearest_wkb,
    # aggregates
    "bbox_aggregate_count": _grouped("count", None),
    "bbox_aggregate_sum": _grouped("sum", "measure"),
    "bbox_aggregate_avg": _grouped("avg", "measure"),
    "bbox_aggregate_min": _grouped("min", "measure"),
    "bbox_aggregate_max": _grouped("max", "quantity"),
    "top_groups": lambda spark, sf: aggregate.group_aggregate(table(spark, sf, "lineitem"), "l_suppkey", "max", "l_extendedprice", k=20),
    "cell_density_quad": _density(2, "quad"),
    "cell_density_quad_fine": _density(6, "quad"),
    "cell_density_hex": _density(3, "hex"),
    "top_cells": lambda spark, sf: aggregate.cell_density(points(spark, sf, "parcels"), BOX, 4, "quad", k=15, include_centre=False),
    # column statistics
    "stats_headline": lambda spark, sf: statistics.headline(points(spark, sf, "parcels"), "measure"),
    "stats_numeric": lambda spark, sf: rounded(
        statistics.numeric_summary(points(spark, sf, "parcels"), "measure"), "mean", "stddev", digits=4
    ),
    "stats_quartiles": lambda spark, sf: rounded(statistics.quartiles(table(spark, sf, "lineitem"), "l_extendedprice"), "p25", "median", "p75"),
    "stats_histogram": lambda spark, sf: rounded(
        statistics.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 10), "lower_bound", "upper_bound", digits=4
    ),
    "stats_topk": lambda spark, sf: statistics.top_values(table(spark, sf, "orders"), "o_custkey", 25),
    "stats_topk_text": lambda spark, sf: statistics.top_values(points(spark, sf, "visits"), "category"),
    "stats_categorical_minmax": lambda spark, sf: statistics.text_bounds(table(spark, sf, "customer"), "c_name"),
    "profile_headline": _profile_part("headline", "parcels", "measure"),
    "profile_summary": _profile_part("summary", "parcels", "measure", "mean", "stddev", "p25", "median", "p75"),
    "profile_histogram": _profile_part("distribution", "parcels", "measure", "lower_bound", "upper_bound"),
    "profile_categories": _profile_part("distribution", "visits", "category"),
    # containment
    "pip_counts": _pip("visits", "areas"),
    "pip_counts_subtype": _pip("visits", "areas", subtype="2"),
    "pip_counts_box": _pip("visits", "areas", box=BOX, k=10),
    "pip_counts_overlapping": _pip("parcels", "zones"),
    "pip_counts_boundary": _pip_lattice,
    "pip_counts_wkb": _pip_wkb,
    "pip_counts_shuffled": _pip("visits", "zones", broadcast_bytes=0),
    "pip_counts_hot_tiles": _pip("parcels", "zones", broadcast_bytes=0, tile_pairs=60),
    "pip_pairs": _pip_pairs,
    "pip_pairs_hot": _pip_pairs_hot,
    "sql_spatial_join": _run_sql(
        "SELECT z.names.primary AS polygon_name, z.subtype AS polygon_subtype, count(*) AS feature_count FROM zones z "
        "JOIN visits p ON st_contains(z.geometry, st_point(p.lon, p.lat)) GROUP BY z.names.primary, z.subtype"
    ),
    "sql_spatial_join_pairs": _sql_join_pairs,
    "sql_spatial_join_edges": lambda spark, sf: run_sql(
        spark, _with_lattice(spark, sf), "SELECT a.names.primary AS polygon_name, count(*) AS n FROM lattice p JOIN areas a "
        "ON st_intersects(st_point(p.lon, p.lat), a.geometry) GROUP BY 1", max_rows=None,
    ),
    "sql_shape_literal": _run_sql(
        f"SELECT names.primary AS polygon_name FROM zones WHERE st_intersects(geometry, st_geomfromtext('{NOTCHED}'))"
    ),
    "pip_areas": lambda spark, sf: containment.count_in_polygons(
        polygons(spark, sf, "plots"), polygons(spark, sf, "areas"), subtype_column="subtype", areal=True
    ),
    # footers
    "footer_footprint": _footprint,
    "footprint": _orders_footprint,
    "file_names": _file_names,
    "geojson_geometry": _geojson_geometry,
    "footer_bounds": _footer_bounds,
    "footer_extent": _footer_extent,
    "footer_pruning": _footer_pruning,
    "pushdown_report": _pushdown,
    "pushdown_single_file": _pushdown_single,
    "footers_kept": _footers_kept,
    "scan_report_multi": _scan_report_multi,
    "geo_documents": _geo_documents,
    "scan_report": _scan_report,
    "schema_roles": _schema_roles,
    # guarded SQL
    **{name: _run_sql(spark_text) for name, (spark_text, _) in sqlsuite.SQL.items()},
}
