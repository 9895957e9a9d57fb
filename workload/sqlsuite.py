"""Free-SQL conformance: (text for the guarded SQL, text for the checking engine)."""

from __future__ import annotations

from workload.views import edge_sql, point_sql


def _same(text: str) -> tuple[str, str]:
    return text, text


def _over_points(text: str) -> tuple[str, str]:
    """A query over the point views, which the checking engine gets as WITH bodies."""
    bodies = ", ".join(f"{view} AS ({point_sql(view)})" for view in ("visits", "parcels"))
    own = text[5:] if text.startswith("WITH ") else None
    twin = f"WITH {bodies}, {own}" if own else f"WITH {bodies} {text}"
    return text, twin


_BOXED = "lon <= 75.5 AND lon >= -60 AND lat <= 48.25 AND lat >= -30"

SQL: dict[str, tuple[str, str]] = {
    "sql_box_groups": _over_points(
        f"SELECT category, count(*) AS n, min(measure) AS low FROM visits WHERE {_BOXED} GROUP BY category"
    ),
    "sql_cte_join": _same(
        "WITH big AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 100000) "
        "SELECT c_mktsegment, count(*) AS n FROM big JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"
    ),
    "sql_left_join": _same(
        "SELECT n_name, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey "
        "GROUP BY n_name"
    ),
    "sql_semi_join": _same(
        "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey "
        "AND o_totalprice > 200000)"
    ),
    "sql_anti_join": _same(
        "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"
    ),
    "sql_in_subquery": _same(
        "SELECT count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10)"
    ),
    "sql_scalar_subquery": _same(
        "SELECT count(*) AS n FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)"
    ),
    "sql_inner_join": _same(
        "SELECT r_name, n_name, count(*) AS n, min(c_acctbal) AS low FROM region JOIN nation ON n_regionkey = r_regionkey "
        "JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name, n_name"
    ),
    "sql_theta_join": _same(
        "WITH per AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey) "
        "SELECT r_name, count(*) AS groups, cast(sum(per.n) AS bigint) AS n FROM region JOIN per ON per.k > r_regionkey "
        "GROUP BY r_name"
    ),
    "sql_cross_join": _same(
        "SELECT r_name, t.n FROM region CROSS JOIN (SELECT count(*) AS n FROM orders) t"
    ),
    "sql_self_join": _same(
        "WITH per AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey) "
        "SELECT a.k, a.n, b.n AS next_n FROM per a JOIN per b ON b.k = a.k + 1"
    ),
    "sql_having": _same(
        "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 15"
    ),
    "sql_window_rank": _same(
        "SELECT * FROM (SELECT c_custkey, c_nationkey, c_acctbal, "
        "cast(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS bigint) AS place, "
        "cast(rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS bigint) AS segment_rank FROM customer) t WHERE place <= 3"
    ),
    "sql_window_lag": _same(
        "SELECT o_orderkey, o_custkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) "
        "AS previous FROM orders"
    ),
    "sql_window_frame": _same(
        "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, sum(l_quantity) OVER (PARTITION BY l_orderkey "
        "ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice "
        "ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent FROM lineitem"
    ),
    "sql_union_all": _over_points(
        "SELECT 'north' AS site, count(*) AS n FROM visits WHERE lat >= 40 "
        "UNION ALL SELECT 'south' AS site, count(*) AS n FROM visits WHERE lat <= -40"
    ),
    "sql_intersect": _same(
        "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier"
    ),
    "sql_except": _same(
        "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 40"
    ),
    "sql_distinct": _same("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem"),
    "sql_cube": _same(
        "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"
    ),
    "sql_rollup": _same(
        "SELECT l_returnflag, l_linestatus, cast(sum(l_linenumber) AS bigint) AS total FROM lineitem "
        "GROUP BY ROLLUP (l_returnflag, l_linestatus)"
    ),
    "sql_grouping_sets": _same(
        "SELECT n_regionkey, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey "
        "GROUP BY GROUPING SETS ((n_regionkey), (c_mktsegment), ())"
    ),
    "sql_filtered_aggregate": _same(
        "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS large, count(*) AS n FROM lineitem "
        "GROUP BY l_returnflag"
    ),
    "sql_dates": _same(
        "SELECT cast(year(o_orderdate) AS bigint) AS y, cast(month(o_orderdate) AS bigint) AS m, count(*) AS n FROM orders "
        "GROUP BY year(o_orderdate), month(o_orderdate)"
    ),
    "sql_outer_limit": _same(
        "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 12"
    ),
    "sql_spatial_functions": (
        "SELECT polygon.names.primary AS polygon_name, st_xmax(geometry) - st_xmin(geometry) AS width, "
        "st_ymin(geometry) AS south FROM zones polygon",
        f"WITH e AS ({edge_sql('zones')}) SELECT polygon_name, max(xmax) - max(xmin) AS width, max(ymin) AS south "
        "FROM e GROUP BY polygon_name",
    ),
    "sql_point_functions": (
        "SELECT id, st_x(st_point(lon, lat)) AS x, st_y(st_point(lon, lat)) AS y, "
        "round(st_distance_sphere(st_point(lon, lat), st_point(2.35D, 48.85D)) / 1000, 3) AS km FROM visits",
        f"SELECT id, lon AS x, lat AS y, round(2 * 6371.0088 * asin(least(1.0, sqrt(power(sin(radians(48.85 - lat) / 2), 2) + "
        f"cos(radians(lat)) * cos(radians(48.85)) * power(sin(radians(2.35 - lon) / 2), 2)))), 3) AS km "
        f"FROM ({point_sql('visits')})",
    ),
    "sql_shape_text": (
        "SELECT id, cast(get_json_object(st_asgeojson(st_point(lon, lat)), '$.coordinates[1]') AS double) AS y, "
        "get_json_object(st_asgeojson(st_geomfromtext('LINESTRING (1 2, 3 4)')), '$.type') AS kind FROM visits",
        f"SELECT id, lat AS y, 'LineString' AS kind FROM ({point_sql('visits')})",
    ),
    "sql_shape_corners": (
        "SELECT polygon.names.primary AS polygon_name, st_ymax(geometry) AS north, st_ymin(geometry) AS south, "
        "st_contains(geometry, st_point((st_xmin(geometry) + st_xmax(geometry)) / 2, (st_ymin(geometry) + st_ymax(geometry)) / 2)) "
        "AS holds_centre FROM areas polygon",
        f"WITH e AS ({edge_sql('areas')}), c AS (SELECT *, (xmin + xmax) / 2 AS lon, (ymin + ymax) / 2 AS lat FROM e) "
        "SELECT polygon_name, max(ymax) AS north, min(ymin) AS south, sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND "
        "(((x2 - x1) * (lat - y1) - (y2 - y1) * (lon - x1)) > 0) = (y2 > y1) THEN 1 ELSE 0 END) % 2 = 1 AS holds_centre "
        "FROM c GROUP BY polygon_name",
    ),
    "sql_cell_centres": (
        "SELECT cell, cell_lon(cell) AS lon, cell_lat(cell) AS lat, count(*) AS n FROM (SELECT cell_id(lon, lat, 3) AS cell FROM visits) GROUP BY cell",
        "SELECT cell, (cx + 0.5) * (360 / 256.0) - 180 AS lon, (cy + 0.5) * (180 / 256.0) - 90 AS lat, count(*) AS n FROM (SELECT *, "
        "lpad(lower(to_hex(3 * 18014398509481984 + cx * 134217728 + cy)), 15, '0') AS cell FROM (SELECT least(cast(floor((lon + 180) / 360 * 256) "
        f"as bigint), 255) AS cx, least(cast(floor((lat + 90) / 180 * 256) as bigint), 255) AS cy FROM ({point_sql('visits')}))) GROUP BY cell, cx, cy",
    ),
    "sql_cells": (
        "SELECT cell_id(lon, lat, 3) AS cell, count(*) AS n FROM visits GROUP BY 1",
        f"SELECT lpad(lower(to_hex(3 * 18014398509481984 + least(cast(floor((lon + 180) / 360 * 256) as bigint), 255) * 134217728 "
        f"+ least(cast(floor((lat + 90) / 180 * 256) as bigint), 255))), 15, '0') AS cell, count(*) AS n "
        f"FROM ({point_sql('visits')}) GROUP BY 1",
    ),
}
