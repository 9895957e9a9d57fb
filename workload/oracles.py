"""The SQL twin of each registered query, for an engine without spatial functions.

Everything spatial is written out as plain arithmetic over whole tables: full-scan
haversine distances, ray crossings over edge tables, grid cells.
"""

from __future__ import annotations

from tessera.functions.cells import hex_edge_km, quad_level
from workload import sqlsuite
from workload.queries import BOX, DETAILED, LATTICE, NOTCHED, SEVERAL, SEVERAL_SHAPES, SMALL
from workload.views import edge_sql, point_sql


def _in(box) -> str:
    return (
        f"(lon <= {box.max_lon} AND lon >= {box.min_lon} AND lat <= {box.max_lat} AND lat >= {box.min_lat})"
    )


def _from(view: str, span: int = 17000) -> str:
    return f"({point_sql(view, span=span)}) p"


_LATTICE_POINTS = (
    "(SELECT o_orderkey AS id, cast((o_orderkey * 7919) % 360 as double) - 180 AS lon, "
    "cast((o_orderkey * 104729) % 170 as double) - 85 AS lat FROM orders) p"
)


# -- nearest --------------------------------------------------------------------------


def _distance(lon: float, lat: float) -> str:
    return (
        f"round(2 * 6371.0088 * asin(least(1.0, sqrt(power(sin(radians({lat} - lat) / 2), 2) + cos(radians(lat)) * "
        f"cos(radians({lat})) * power(sin(radians({lon} - lon) / 2), 2)))), 4)"
    )


def _nearest(lon: float, lat: float, radius: float, view: str = "visits", span: int = 17000, k: int | None = 25) -> str:
    cut = f" ORDER BY distance_km, id LIMIT {k}" if k else ""
    return (
        f"SELECT id, category, distance_km FROM (SELECT id, category, {_distance(lon, lat)} AS distance_km "
        f"FROM {_from(view, span)}) WHERE distance_km <= {radius}{cut}"
    )


# -- shapes ---------------------------------------------------------------------------


def _literal_edges(rings: list[list[tuple[float, float]]]) -> str:
    sides = [(a, b) for ring in rings for a, b in zip(ring, ring[1:])]
    rows = ", ".join(f"({ax}::double, {ay}::double, {bx}::double, {by}::double)" for (ax, ay), (bx, by) in sides)
    return f"(VALUES {rows}) s(x1, y1, x2, y2)"


def _rings(text: str) -> list[list[tuple[float, float]]]:
    """Rings of a literal written without nested number formats."""
    inner = text[text.index("(") :].replace("(", " ( ").replace(")", " ) ")
    rings = []
    for chunk in inner.split(")"):
        numbers = chunk.split("(")[-1].strip(" ,")
        if numbers:
            rings.append([tuple(map(float, pair.split())) for pair in numbers.split(",")])
    return rings


_SIDE = "((x2 - x1) * (lat - y1) - (y2 - y1) * (lon - x1))"
_CROSSES = f"CASE WHEN (y1 > lat) <> (y2 > lat) AND ({_SIDE} > 0) = (y2 > y1) THEN 1 ELSE 0 END"
_TOUCHES = (
    f"CASE WHEN {_SIDE} = 0 AND lon BETWEEN least(x1, x2) AND greatest(x1, x2) "
    "AND lat BETWEEN least(y1, y2) AND greatest(y1, y2) THEN 1 ELSE 0 END"
)


def _touching(points: str, text: str) -> str:
    """Points in or on a shape whose polygons do not overlap."""
    return (
        f"SELECT id FROM (SELECT id, lon, lat, row_number() OVER () AS rid FROM {points}), {_literal_edges(_rings(text))} "
        f"GROUP BY rid, id HAVING sum({_CROSSES}) % 2 = 1 OR sum({_TOUCHES}) > 0"
    )


def _inside(points: str, areas: str, keep: str) -> str:
    return (
        f"SELECT {keep} FROM (SELECT id, lon, lat, row_number() OVER () AS rid FROM {points}) "
        f"JOIN (SELECT *, 0 AS unused FROM ({edge_sql(areas)})) ON lon BETWEEN xmin AND xmax AND lat BETWEEN ymin AND ymax "
        f"GROUP BY rid, id, polygon_name, polygon_subtype HAVING sum({_CROSSES}) % 2 = 1 AND sum({_TOUCHES}) = 0"
    )


def _counts(points: str, areas: str, where: str = "") -> str:
    inside = _inside(points, areas, "polygon_name, polygon_subtype")
    return (
        f"SELECT polygon_name, polygon_subtype, count(*) AS feature_count FROM ({inside}) {where} "
        f"GROUP BY polygon_name, polygon_subtype"
    )


def _polygons_meeting(areas: str, text: str) -> str:
    """Polygons that share a point with a shape: sides meet, or one lies inside the other."""
    rings = _rings(text)
    sides = _literal_edges(rings).replace("s(x1, y1, x2, y2)", "t(u1, v1, u2, v2)")
    corner = rings[0][0]

    def side(px: str, py: str, a: str, b: str) -> str:
        return f"sign(({b[0]} - {a[0]}) * ({py} - {a[1]}) - ({b[1]} - {a[1]}) * ({px} - {a[0]}))"

    def cross(a1, a2, b1, b2):
        first = side(b1[0], b1[1], a1, a2)
        second = side(b2[0], b2[1], a1, a2)
        return f"{first} * {second} <= 0"

    p, q, u, v = ("x1", "y1"), ("x2", "y2"), ("u1", "v1"), ("u2", "v2")
    apart = (
        "greatest(x1, x2) < least(u1, u2) OR greatest(u1, u2) < least(x1, x2) "
        "OR greatest(y1, y2) < least(v1, v2) OR greatest(v1, v2) < least(y1, y2)"
    )
    meets = f"NOT ({apart}) AND {cross(p, q, u, v)} AND {cross(u, v, p, q)}"
    start_in = (
        "(v1 > y1) <> (v2 > y1) AND (((u2 - u1) * (y1 - v1) - (v2 - v1) * (x1 - u1)) > 0) = (v2 > v1)"
    )
    corner_in = (
        f"(y1 > {corner[1]}) <> (y2 > {corner[1]}) AND (((x2 - x1) * ({corner[1]} - y1) - (y2 - y1) * ({corner[0]} - x1)) > 0) = (y2 > y1)"
    )
    return (
        f"WITH e AS ({edge_sql(areas)}) "
        f"SELECT polygon_name FROM e, {sides} GROUP BY polygon_name HAVING bool_or({meets}) "
        f"UNION SELECT polygon_name FROM e, {sides} GROUP BY polygon_name, x1, y1 "
        f"HAVING sum(CASE WHEN {start_in} THEN 1 ELSE 0 END) % 2 = 1 "
        f"UNION SELECT polygon_name FROM e GROUP BY polygon_name "
        f"HAVING sum(CASE WHEN {corner_in} THEN 1 ELSE 0 END) % 2 = 1"
    )


def _areas_inside(inner: str, outer: str) -> str:
    """Polygons strictly inside others, for shapes that never touch: every corner is
    inside and no sides cross."""
    p, q, u, v = ("z.x1", "z.y1"), ("z.x2", "z.y2"), ("e.x1", "e.y1"), ("e.x2", "e.y2")

    def side(a, b, c):
        return f"sign(({b[0]} - {a[0]}) * ({c[1]} - {a[1]}) - ({b[1]} - {a[1]}) * ({c[0]} - {a[0]}))"

    crossing = f"{side(p, q, u)} * {side(p, q, v)} < 0 AND {side(u, v, p)} * {side(u, v, q)} < 0"
    corner = "(e.y1 > z.y1) <> (e.y2 > z.y1) AND ({} > 0) = (e.y2 > e.y1)".format(
        "((e.x2 - e.x1) * (z.y1 - e.y1) - (e.y2 - e.y1) * (z.x1 - e.x1))"
    )
    return (
        f"WITH z AS ({edge_sql(inner)}), e AS ({edge_sql(outer)}), "
        "c AS (SELECT z.polygon_name AS plot, e.polygon_name, e.polygon_subtype, z.x1, z.y1, "
        f"sum(CASE WHEN {corner} THEN 1 ELSE 0 END) % 2 AS inside, bool_or({crossing}) AS crossed FROM z JOIN e "
        "ON z.xmin >= e.xmin AND z.xmax <= e.xmax AND z.ymin >= e.ymin AND z.ymax <= e.ymax GROUP BY ALL), "
        "w AS (SELECT plot, polygon_name, polygon_subtype FROM c GROUP BY ALL HAVING min(inside) = 1 AND NOT bool_or(crossed)) "
        "SELECT polygon_name, polygon_subtype, count(*) AS feature_count FROM w GROUP BY ALL"
    )


# -- cells ----------------------------------------------------------------------------

_X = 134217728  # 2^27
_HALF_X = 67108864  # 2^26


def _text(cell: str) -> str:
    return f"lpad(lower(to_hex(cast({cell} as bigint))), 15, '0')"


def _quad(view: str, resolution: int, box=BOX) -> str:
    n = 1 << quad_level(resolution)
    return (
        f"SELECT {_text('id')} AS cell, round(((id % {_X}) + 0.5::double) * (180.0::double / {n}) - 90.0::double, 6) AS centre_lat, "
        f"round((((id // {_X}) % {_X}) + 0.5::double) * (360.0::double / {n}) - 180.0::double, 6) AS centre_lon, feature_count FROM ("
        f"SELECT cast({resolution} as bigint) * {_X} * {_X} "
        f"+ least(cast(floor((lon + 180.0::double) / 360.0::double * {n}) as bigint), {n - 1}) * {_X} "
        f"+ least(cast(floor((lat + 90.0::double) / 180.0::double * {n}) as bigint), {n - 1}) AS id, count(*) AS feature_count "
        f"FROM {_from(view)} WHERE {_in(box)} GROUP BY 1)"
    )


def _hex(view: str, resolution: int, box=BOX) -> str:
    edge = f"{hex_edge_km(resolution)!r}::double"
    radius = "6371.0088::double"
    third = f"{3.0 ** 0.5 / 3.0!r}::double"
    return (
        f"WITH a AS (SELECT radians(lon) * {radius} AS x, sin(radians(lat)) * {radius} AS y FROM {_from(view)} WHERE {_in(box)}), "
        f"b AS (SELECT x * {2.0 / 3.0!r}::double / {edge} AS q, (y * {third} - x / 3.0::double) / {edge} AS r FROM a), "
        "c AS (SELECT q, r, -q - r AS s, floor(q + 0.5::double) AS rq, floor(r + 0.5::double) AS rr, floor(-q - r + 0.5::double) AS rs FROM b), "
        "d AS (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs - s) AS ds FROM c), "
        "e AS (SELECT CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS cq, "
        "CASE WHEN dq > dr AND dq > ds THEN rr WHEN dr > ds THEN -rq - rs ELSE rr END AS cr FROM d), "
        "f AS (SELECT cq, cr, count(*) AS feature_count FROM e GROUP BY cq, cr) "
        f"SELECT {_text(f'cast({resolution} as bigint) * {_X} * {_X} + cast(cq + {_HALF_X} as bigint) * {_X} + cast(cr + {_HALF_X} as bigint)')} AS cell, "
        f"round(degrees(asin(greatest(-1.0::double, least(1.0::double, {3.0 ** 0.5 * hex_edge_km(resolution)!r}::double * (cr + cq / 2.0::double) / {radius})))), 6) AS centre_lat, "
        f"round(degrees({1.5 * hex_edge_km(resolution)!r}::double * cq / {radius}), 6) AS centre_lon, feature_count FROM f"
    )


# -- statistics -----------------------------------------------------------------------


def _histogram(source: str, column: str, where: str, digits: int, buckets: int = 10) -> str:
    return (
        f"WITH v AS (SELECT {column} AS x FROM {source} {where}), "
        "f AS (SELECT min(x) AS low, max(x) AS high, count(*) AS n FROM v) "
        f"SELECT bucket, round(low + bucket * ((high - low) / {buckets}.0::double), {digits}) AS lower_bound, "
        f"round(low + (bucket + 1) * ((high - low) / {buckets}.0::double), {digits}) AS upper_bound, "
        "\"count\", round(\"count\"::double / n, 6) AS share FROM ("
        f"SELECT cast(least(floor((x - low) / ((high - low) / {buckets}.0::double)), {buckets - 1}) as bigint) AS bucket, "
        "count(*) AS \"count\" FROM v, f WHERE x IS NOT NULL AND high > low GROUP BY 1), f"
    )


def _top(source: str, column: str, k: int = 25) -> str:
    return (
        f"SELECT cast({column} as varchar) AS value, count(*) AS \"count\", "
        f"round(count(*)::double / (SELECT count(*) FROM {source}), 6) AS share FROM {source} GROUP BY 1 "
        f"ORDER BY \"count\" DESC, value LIMIT {k}"
    )


def _grouped(value: str) -> str:
    return (
        f"SELECT category AS group_value, {value} AS value, count(*) AS row_count FROM {_from('parcels')} "
        f"WHERE {_in(BOX)} GROUP BY category"
    )


_PLACES = _from("places")
_SAMPLE = f"(SELECT * FROM {_from('parcels')} WHERE {_in(BOX)}) v"

ORACLES: dict[str, str] = {
    "bbox_filter": f"SELECT id, measure FROM {_PLACES} WHERE {_in(BOX)}",
    "bbox_filter_multi": f"SELECT id, confidence FROM {_PLACES} WHERE {' OR '.join(map(_in, SEVERAL))}",
    "filter_category": f"SELECT id, confidence FROM {_PLACES} WHERE {_in(BOX)} AND category = 'BUILDING'",
    "filter_name_contains": f"SELECT id, confidence FROM {_PLACES} WHERE {_in(BOX)} AND lower(name) LIKE '%customer#0000001%'",
    "filter_name_wildcards": f"SELECT id, confidence FROM {_PLACES} WHERE {_in(BOX)} AND lower(name) LIKE '%r#_00%7%'",
    "filter_min_confidence": f"SELECT id, confidence FROM {_PLACES} WHERE {_in(BOX)} AND confidence >= 0.75",
    "attribute_filters": f"SELECT id, confidence FROM {_PLACES} WHERE {_in(BOX)} AND category = 'MACHINERY' "
    "AND lower(name) LIKE '%customer#%' AND confidence >= 0.4",
    "projection_nested": f"SELECT id, name, 'Street ' || id AS street, cast(NULL as varchar) AS missing FROM {_PLACES} WHERE {_in(BOX)}",
    "wkt_filter": _touching(_from("visits"), NOTCHED),
    "wkt_filter_boundary": _touching(_LATTICE_POINTS, LATTICE),
    "wkt_filter_multipolygon": _touching(_from("visits"), SEVERAL_SHAPES),
    "wkt_filter_detailed": _touching(_from("visits"), DETAILED),
    "wkt_filter_polygons": _polygons_meeting("zones", NOTCHED),
    "geojson_points": "SELECT id, 'Feature' AS type, 'Point' AS geometry_type, lon, lat, name, confidence "
    f"FROM {_PLACES} WHERE {_in(BOX)}",
    "extent_scan": "SELECT min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat, "
    f"count(*) AS rows_examined FROM {_from('parcels')}",
    "read_forcing": f"SELECT count(*) AS matches, max(length(name)) AS longest_name FROM {_PLACES} WHERE {_in(BOX)}",
    "busiest_file": f"SELECT cast(floor(lon / 90) as int) AS band, count(*) AS matches FROM {_from('parcels')} WHERE {_in(BOX)} "
    "GROUP BY 1 ORDER BY matches DESC LIMIT 1",
    "preview": "SELECT c_custkey, c_name FROM customer LIMIT 7",
    "preview_filtered": "SELECT c_custkey, c_name FROM customer WHERE c_custkey > 100 ORDER BY c_custkey LIMIT 7",
    "preview_view": f"SELECT id, category FROM {_from('visits')} WHERE id > 20 ORDER BY id LIMIT 5",
    "filter_limited": f"SELECT id, measure FROM {_from('visits')} WHERE {_in(BOX)} ORDER BY id LIMIT 1400",
    "sql_limit": "SELECT * FROM (SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 50) LIMIT 12",
    "file_names": "SELECT 'customer.parquet' AS file, count(*) AS row_count FROM customer",
    "geojson_geometry": f"SELECT id, 'Point' AS type, lon, lat FROM {_from('visits')}",
    "footprint": "SELECT count(*) AS row_count, cast(1 as bigint) AS files, true AS has_bytes FROM orders",
    "nearest_point": _nearest(2.35, 48.85, 400.0),
    "nearest_all_in_radius": _nearest(-70.25, -12.5, 350.0, "parcels", k=None),
    "nearest_pole": _nearest(30.0, 89.5, 450.0, span=18000),
    "nearest_antimeridian": _nearest(179.9, 10.0, 500.0),
    "nearest_wkb": _nearest(2.35, 48.85, 400.0),
    "bbox_aggregate_count": _grouped("count(*)"),
    "bbox_aggregate_sum": _grouped("round(sum(measure), 2)"),
    "bbox_aggregate_avg": _grouped("round(avg(measure), 6)"),
    "bbox_aggregate_min": _grouped("min(measure)"),
    "bbox_aggregate_max": _grouped("max(quantity)"),
    "top_groups": "SELECT l_suppkey AS group_value, max(l_extendedprice) AS value, count(*) AS row_count FROM lineitem "
    "GROUP BY l_suppkey ORDER BY value DESC NULLS LAST, group_value LIMIT 20",
    "cell_density_quad": _quad("parcels", 2),
    "cell_density_quad_fine": _quad("parcels", 6),
    "cell_density_hex": _hex("parcels", 3),
    "top_cells": f"SELECT cell, feature_count FROM ({_quad('parcels', 4)}) ORDER BY feature_count DESC, cell LIMIT 15",
    "stats_headline": "SELECT count(*) AS row_count, count(measure) AS non_null_count, count(*) - count(measure) AS null_count, "
    f"count(DISTINCT measure) AS distinct_values FROM {_from('parcels')}",
    "stats_numeric": "SELECT min(measure) AS minimum, max(measure) AS maximum, round(avg(measure), 4) AS mean, "
    f"round(stddev_samp(measure), 4) AS stddev FROM {_from('parcels')}",
    "stats_quartiles": "SELECT round(quantile_cont(l_extendedprice, 0.25), 6) AS p25, round(quantile_cont(l_extendedprice, 0.5), 6) "
    "AS median, round(quantile_cont(l_extendedprice, 0.75), 6) AS p75 FROM lineitem",
    "stats_histogram": _histogram("lineitem", "l_extendedprice", "", 4),
    "stats_topk": _top("orders", "o_custkey"),
    "stats_topk_text": _top("orders", "o_orderpriority"),
    "stats_categorical_minmax": "SELECT cast(min(c_name) as varchar) AS minimum, cast(max(c_name) as varchar) AS maximum FROM customer",
    "profile_headline": "SELECT count(*) AS row_count, count(measure) AS non_null_count, count(*) - count(measure) AS null_count, "
    f"count(DISTINCT measure) AS distinct_values FROM {_SAMPLE}",
    "profile_summary": "SELECT min(measure) AS minimum, max(measure) AS maximum, round(avg(measure), 6) AS mean, "
    "round(stddev_samp(measure), 6) AS stddev, round(quantile_cont(measure, 0.25), 6) AS p25, "
    f"round(quantile_cont(measure, 0.5), 6) AS median, round(quantile_cont(measure, 0.75), 6) AS p75 FROM {_SAMPLE}",
    "profile_histogram": _histogram(_from("parcels"), "measure", f"WHERE {_in(BOX)}", 6),
    "profile_categories": _top(f"(SELECT * FROM {_from('visits')} WHERE {_in(BOX)}) v", "category"),
    "pip_counts": _counts(_from("visits"), "areas"),
    "pip_counts_subtype": _counts(_from("visits"), "areas", "WHERE polygon_subtype = '2'"),
    "pip_counts_box": "SELECT * FROM ("
    + _counts(f"(SELECT * FROM {_from('visits')} WHERE {_in(BOX)}) p", "areas")
    + ") ORDER BY feature_count DESC, polygon_name, polygon_subtype LIMIT 10",
    "pip_counts_overlapping": _counts(_from("parcels"), "zones"),
    "pip_counts_boundary": _counts(_LATTICE_POINTS, "areas"),
    "pip_counts_wkb": _counts(_from("visits"), "areas"),
    "pip_counts_shuffled": _counts(_from("visits"), "zones"),
    "pip_counts_hot_tiles": _counts(_from("parcels"), "zones"),
    "pip_pairs": _inside(_from("visits"), "zones", "id, polygon_name"),
    "pip_pairs_hot": f"SELECT id % 5 AS label, polygon_name FROM ({_inside(_from('visits'), 'zones', 'id, polygon_name')}) p, range(3)",
    "sql_spatial_join": _counts(_from("visits"), "zones"),
    "sql_spatial_join_pairs": "SELECT id, polygon_name, lon, category FROM ("
    + _inside(_from("visits"), "zones", "id, polygon_name, polygon_subtype").replace("SELECT id, lon, lat,", "SELECT *,", 1)
    + f") JOIN (SELECT id, lon, category, measure FROM {_from('visits')}) v USING (id) "
    "WHERE polygon_subtype >= '2' AND measure > 50000 AND (id + cast(polygon_subtype as int)) % 3 <> 0",
    "sql_spatial_join_edges": "SELECT polygon_name, count(*) AS n FROM (" + _inside(_LATTICE_POINTS, "areas", "id, polygon_name").replace(
        f"HAVING sum({_CROSSES}) % 2 = 1 AND sum({_TOUCHES}) = 0", f"HAVING sum({_CROSSES}) % 2 = 1 OR sum({_TOUCHES}) > 0"
    ) + ") GROUP BY polygon_name",
    "sql_shape_literal": _polygons_meeting("zones", NOTCHED),
    "pip_areas": _areas_inside("plots", "areas"),
    "footer_footprint": " UNION ALL ".join(
        f"SELECT '{name}' AS name, count(*) AS row_count, cast(1 as bigint) AS files FROM {name}"
        for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
    ),
    "footer_bounds": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", cast(min({c}) as double) AS minimum, cast(max({c}) as double) AS maximum, true AS complete FROM lineitem"
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_orderkey", "l_linenumber")
    ),
    "footer_extent": "SELECT min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat, "
    f"true AS complete FROM {_from('parcels')}",
    "footer_pruning": f"SELECT count(*) AS rows, count(*) FILTER (WHERE {_in(SMALL)}) AS matches, true AS keeps_matches, "
    f"true AS never_more FROM {_from('parcels')}",
    "pushdown_report": f"SELECT 'whole_dataset' AS mode, count(*) AS matches FROM {_from('parcels')} WHERE {_in(SMALL)}",
    "pushdown_single_file": f"SELECT 'single_file' AS mode, count(*) FILTER (WHERE {_in(SMALL)}) AS matches, true AS never_more, "
    f"count(*) AS rows FROM {_from('parcels')}",
    "footers_kept": "SELECT cast(floor(lon / 90) as int) AS band, count(*) AS row_count, min(measure) AS low, max(measure) AS high "
    f"FROM {_from('parcels')} GROUP BY 1",
    "scan_report_multi": "WITH g AS (SELECT floor(lon / 90) AS band, count(*) AS n, min(lon) AS lon0, max(lon) AS lon1, min(lat) AS lat0, "
    f"max(measure) AS m1, min(id) AS id0, max(id) AS id1 FROM {_from('parcels')} GROUP BY 1), "
    "r AS (SELECT *, ((lon1 > 95 AND lat0 <= 10) OR (lon0 < -100 AND lat0 < -20)) AND m1 >= 950 AND "
    "((id0 <= 9 AND id1 >= 9) OR (id0 <= 17 AND id1 >= 17) OR (id0 <= 1000000000 AND id1 >= 1000000000)) AS read FROM g) "
    "SELECT cast(coalesce(sum(n) FILTER (WHERE read), 0) as bigint) AS rows_read, count(*) FILTER (WHERE read) AS row_groups_read, "
    "count(*) FILTER (WHERE read) AS files_touched, cast(sum(n) as bigint) AS rows, count(*) AS files FROM r",
    "geo_documents": "SELECT n_regionkey::BIGINT AS region, CASE n_regionkey WHEN 0 THEN 'OGC:CRS84' WHEN 1 THEN 'EPSG:' || min(n_nationkey + 4000)::VARCHAR "
    "WHEN 4 THEN 'unknown' ELSE min(n_name) END AS crs, n_regionkey = 0 AS crs_is_default, 'WKB' AS encoding, '1.0.0' AS geoparquet_version "
    "FROM nation GROUP BY n_regionkey",
    "scan_report": "SELECT count(*) AS rows_read, count(*) AS rows, cast(1 as bigint) AS files, true AS reads_something FROM lineitem",
    "schema_roles": "SELECT column_name AS \"column\", CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' "
    "WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS type, CASE column_name WHEN 'o_orderpriority' THEN 'name' "
    "WHEN 'o_orderstatus' THEN 'category' END AS role, (SELECT count(*) FROM orders) AS row_count "
    "FROM (DESCRIBE SELECT * FROM orders)",
    **{name: twin for name, (_, twin) in sqlsuite.SQL.items()},
}
