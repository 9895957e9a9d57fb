"""Parquet footers as a table, read by the executors.

A listing of the files (paths and lengths only) is spread over the cluster and each task
reads the footers of its files: one row per file, row group and column. Everything the
engine knows without touching a data page comes from this table: footprint, extent, the
``geo`` document and the cost of a query. For very many files, write it once
(``footers(...).write.parquet``) and pass the stored table to the functions below.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import StatisticsMissingError
from tessera.functions.boxes import BoundingBox

_ARROW = pa.schema(
    [
        ("file", pa.string()),
        ("file_bytes", pa.int64()),
        ("footer_bytes", pa.int64()),
        ("file_rows", pa.int64()),
        ("file_row_groups", pa.int32()),
        ("geo", pa.string()),
        ("row_group", pa.int32()),
        ("group_rows", pa.int64()),
        ("column", pa.string()),
        ("compressed_bytes", pa.int64()),
        ("min_value", pa.string()),
        ("max_value", pa.string()),
    ]
)
SCHEMA = (
    "file string, file_bytes bigint, footer_bytes bigint, file_rows bigint, file_row_groups int, geo string, "
    "row_group int, group_rows bigint, `column` string, compressed_bytes bigint, min_value string, max_value string"
)


def _text(value) -> str | None:
    if value is None or isinstance(value, bytes):  # plain bytes have no order that text has
        return None
    return repr(value) if isinstance(value, float) else str(value)


def _open(path: str):
    """The file system of a path as Spark writes it (not percent-encoded)."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return pafs.LocalFileSystem(), "/" + (rest or scheme).lstrip("/")
    # The S3 connectors of Hadoop have their own scheme names.
    return pafs.FileSystem.from_uri(f"s3:{rest}" if scheme in ("s3a", "s3n") else path)


def _read_footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            filesystem, inner = _open(path)
            with filesystem.open_input_file(inner) as handle:
                meta = pq.read_metadata(handle)
            geo = (meta.metadata or {}).get(b"geo")
            about_file = {
                "file": path,
                "file_bytes": length,
                "footer_bytes": meta.serialized_size,
                "file_rows": meta.num_rows,
                "file_row_groups": meta.num_row_groups,
            }
            document = {"geo": geo.decode("utf-8") if geo is not None else None}
            rows = []
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                for c in range(group.num_columns):
                    chunk = group.column(c)
                    stats = chunk.statistics
                    known = stats is not None and stats.has_min_max
                    rows.append(
                        about_file
                        | {
                            "row_group": g,
                            "group_rows": group.num_rows,
                            "column": chunk.path_in_schema,
                            "compressed_bytes": chunk.total_compressed_size,
                            "min_value": _text(stats.min) if known else None,
                            "max_value": _text(stats.max) if known else None,
                        }
                    )
            # The document can be long, so only the file's first row carries it. A file
            # without row groups still counts as a file.
            rows = rows or [about_file]
            rows[0] |= document
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def listing(spark: SparkSession, *paths: str) -> DataFrame:
    """``path``, ``length`` and ``modificationTime`` of every Parquet file; no file is opened."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", "true")
        .load(list(paths))
        .select("path", "length", "modificationTime")
    )


def footers_of(files: DataFrame) -> DataFrame:
    """The footer table of listed files, read on the executors."""
    return files.select("path", "length").mapInArrow(_read_footers, SCHEMA)


def footers(spark: SparkSession, *paths: str) -> DataFrame:
    """The footer table of every Parquet file under the given paths."""
    return footers_of(listing(spark, *paths))


def _files(footer_table: DataFrame) -> DataFrame:
    """One row per file."""
    return footer_table.groupBy("file").agg(
        F.first("file_bytes").alias("file_bytes"),
        F.first("footer_bytes").alias("footer_bytes"),
        F.first("file_rows").alias("file_rows"),
        F.first("file_row_groups").alias("file_row_groups"),
    )


def footprint(footer_table: DataFrame) -> DataFrame:
    """Files, rows, bytes and row groups; no data page is read."""
    return _files(footer_table).agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("file_rows"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum("file_bytes"), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum("file_row_groups"), F.lit(0)).cast("bigint").alias("row_groups"),
        F.coalesce(F.sum("footer_bytes"), F.lit(0)).alias("footer_bytes"),
    )


def _number(column: str) -> Column:
    return F.col(column).try_cast(T.DoubleType())


def column_bounds(footer_table: DataFrame) -> DataFrame:
    """Smallest minimum and largest maximum of each column whose statistics are numbers.

    ``complete`` says whether every row group had statistics for the column.
    """
    return (
        footer_table.where(F.col("column").isNotNull())
        .groupBy("column")
        .agg(
            F.min(_number("min_value")).alias("minimum"),
            F.max(_number("max_value")).alias("maximum"),
            F.count(F.lit(1)).alias("row_groups"),
            F.bool_and(_number("min_value").isNotNull() & _number("max_value").isNotNull()).alias("complete"),
        )
    )


def extent(footer_table: DataFrame, bbox: str = "bbox") -> DataFrame:
    """The rectangle around everything, from the statistics of the bbox members.

    ``complete`` is false when some row group has no statistics: the rectangle is then a
    lower bound only.
    """

    def member(name: str, value: str) -> Column:
        return F.when(F.col("column") == f"{bbox}.{name}", _number(value))

    of_bbox = F.col("column").isin([f"{bbox}.{m}" for m in ("xmin", "xmax", "ymin", "ymax")])
    return footer_table.agg(
        F.min(member("xmin", "min_value")).alias("min_lon"),
        F.min(member("ymin", "min_value")).alias("min_lat"),
        F.max(member("xmax", "max_value")).alias("max_lon"),
        F.max(member("ymax", "max_value")).alias("max_lat"),
        F.count(F.when(F.col("column") == f"{bbox}.xmin", 1)).alias("row_groups"),
        F.coalesce(
            F.bool_and(F.when(of_bbox & (F.col("group_rows") > 0), _number("min_value").isNotNull())), F.lit(False)
        ).alias("complete"),
    )


def require_extent(extent_row: DataFrame, name: str) -> DataFrame:
    """The extent, or an error when the footers cannot give it."""
    row = extent_row.first()
    if row["min_lon"] is None:
        raise StatisticsMissingError(
            f"the files of {name!r} carry no statistics on the bbox members; "
            f"ask for a scan instead, which reads those four columns in full"
        )
    return extent_row


_GEO = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField("primary_column", T.StringType()),
        T.StructField(
            "columns",
            T.MapType(
                T.StringType(),
                T.StructType(
                    [
                        T.StructField("encoding", T.StringType()),
                        T.StructField("geometry_types", T.ArrayType(T.StringType())),
                        T.StructField("crs", T.StringType()),
                    ]
                ),
            ),
        ),
    ]
)


def geo_metadata(footer_table: DataFrame) -> DataFrame:
    """CRS, encoding, geometry types and version from the ``geo`` key of the first file
    that has one; one row of NULLs when none has."""
    first = footer_table.agg(F.min_by("geo", F.when(F.col("geo").isNotNull(), F.col("file"))).alias("geo"))
    document = first.select(F.from_json("geo", _GEO).alias("d"), "geo")
    column = F.try_element_at(F.col("d.columns"), F.col("d.primary_column"))
    crs = column.getField("crs")
    authority = F.get_json_object(crs, "$.id.authority")
    code = F.get_json_object(crs, "$.id.code")
    is_object = F.coalesce(F.ltrim(crs).startswith("{"), F.lit(False))
    return document.select(
        F.when(F.col("geo").isNull(), F.lit(None).cast("string"))
        .when(crs.isNull(), F.lit("OGC:CRS84"))
        .when(~is_object, crs)
        .when(authority.isNotNull() & code.isNotNull(), F.concat(authority, F.lit(":"), code))
        .otherwise(F.coalesce(F.get_json_object(crs, "$.name"), F.lit("unknown")))
        .alias("crs"),
        F.when(F.col("geo").isNotNull(), crs.isNull()).alias("crs_is_default"),
        column.getField("encoding").alias("encoding"),
        F.coalesce(column.getField("geometry_types"), F.array().cast("array<string>")).alias("geometry_types"),
        F.col("d.version").alias("geoparquet_version"),
    )


# -- which row groups a filter leaves ---------------------------------------------------

#: A filter over statistics: ``(path, operator, value)`` with ``<= < >= > = in``, or ``("and", [...])``,
#: ``("or", [...])``, ``("not", filter)``; None stands for a condition statistics say nothing about.
Filter = tuple | None


def filter_paths(tree: Filter) -> list[str]:
    if tree is None:
        return []
    if tree[0] in ("and", "or"):
        return [path for part in tree[1] for path in filter_paths(part)]
    return filter_paths(tree[1]) if tree[0] == "not" else [tree[0]]


def _possible(tree: Filter, bounds: dict[str, tuple[Column, Column]]) -> tuple[Column, Column]:
    """Whether some value within the bounds can make the filter true, and whether one can make it false.

    Missing bounds allow both. NULLs make a comparison neither, so they select no row either way.
    """
    yes = F.lit(True)
    if tree is None:
        return yes, yes
    kind = tree[0]
    if kind in ("and", "or"):
        parts = [_possible(part, bounds) for part in tree[1]]
        if not parts:
            return (yes, F.lit(False)) if kind == "and" else (F.lit(False), yes)
        both = lambda side, join: functools.reduce(join, (p[side] for p in parts))
        first, second = (operator.and_, operator.or_) if kind == "and" else (operator.or_, operator.and_)
        return both(0, first), both(1, second)
    if kind == "not":
        true, false = _possible(tree[1], bounds)
        return false, true
    path, op, value = tree
    if op == "in":
        true, false = _possible(("or", [(path, "=", v) for v in value]), bounds)
        return true, false
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        return yes, yes
    low, high = bounds[path]
    if isinstance(value, str):
        bound = F.lit(value)
    else:
        low, high, bound = low.try_cast(T.DoubleType()), high.try_cast(T.DoubleType()), F.lit(float(value))
    true, false = {
        "<=": (low <= bound, high > bound),
        "<": (low < bound, high >= bound),
        ">=": (high >= bound, low < bound),
        ">": (high > bound, low <= bound),
        "=": ((low <= bound) & (high >= bound), (low != bound) | (high != bound)),
    }[op]
    return F.coalesce(true, yes), F.coalesce(false, yes)


def scan_report(
    footer_table: DataFrame,
    columns: Sequence[str],
    comparisons: Sequence[tuple[str, str, float]] | BoundingBox | Filter = (),
    bbox: str = "bbox",
) -> DataFrame:
    """What a scan of `columns` has to read, computed before it runs.

    `columns` are top-level columns or nested members; `comparisons` are ``(path, operator,
    value)`` facts that all must hold, a rectangle, or a whole `Filter` of AND, OR, NOT and IN. A row group
    is read when some value within its statistics can satisfy the filter, or they are missing. One
    row: bytes, row groups, rows and files that survive, the same without pruning, and the ratio.
    """
    if isinstance(comparisons, BoundingBox):
        comparisons = comparisons.comparisons(bbox)
    tree = comparisons
    if tree is None or not (isinstance(tree, tuple) and tree and isinstance(tree[0], str)):
        tree = ("and", list(tree or ()))
    paths = list(dict.fromkeys(filter_paths(tree)))
    name = F.col("column")
    needed = F.lit(False)
    for path in [*columns, *paths]:
        needed = needed | (name == path) | name.startswith(path + ".")
    bounds = {path: (F.col(f"low_{k}"), F.col(f"high_{k}")) for k, path in enumerate(paths)}
    ends = [
        F.max(F.when(name == path, F.col(f"{end}_value"))).alias(f"{side}_{k}")
        for k, path in enumerate(paths)
        for side, end in (("low", "min"), ("high", "max"))
    ]
    groups = (
        footer_table.where(name.isNotNull())
        .groupBy("file", "row_group")
        .agg(
            *ends,
            F.coalesce(F.sum(F.when(needed, F.col("compressed_bytes"))), F.lit(0)).alias("bytes"),
            F.first("group_rows").alias("rows"),
        )
        .withColumn("read", _possible(tree, bounds)[0])
    )
    read = F.col("read")

    def total(value: str, condition: Column | None = None) -> Column:
        column = F.col(value) if condition is None else F.when(condition, F.col(value))
        return F.coalesce(F.sum(column), F.lit(0))

    report = groups.agg(
        total("bytes", read).alias("bytes_scanned"),
        F.count(F.when(read, 1)).alias("row_groups_read"),
        total("rows", read).alias("rows_read"),
        F.count_distinct(F.when(read, F.col("file"))).alias("files_touched"),
        total("bytes").alias("bytes_unpruned"),
        F.count(F.lit(1)).alias("row_groups"),
        total("rows").alias("rows"),
        F.count_distinct("file").alias("files"),
    )
    return report.withColumn(
        "pruning_ratio",
        F.when(F.col("bytes_scanned") > 0, F.round(F.col("bytes_unpruned") / F.col("bytes_scanned"), 1)),
    )

