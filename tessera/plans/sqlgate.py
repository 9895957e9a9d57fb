"""Free SQL over the catalogue's datasets, and nothing else.

Spark parses the statement; what its parser returns is checked before anything is analysed
or read. Plan nodes and function groups are on an allow-list, so a construct nobody thought
of is refused. Every constructor argument of every node is followed: subqueries, the bodies
of common table expressions and lateral joins are not all reachable as plain children.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.errors import ParseException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

from tessera.errors import CapabilityUnavailableError, InvalidRequestError, QueryTimeoutError
from tessera.functions.spatial import SQL_FUNCTIONS, register_functions
from tessera.plans.spatialjoin import SpatialRewrite, register_join_functions
from tessera.sources.catalog import Catalog
from tessera.sources.footers import Filter, footers, scan_report

DEFAULT_MAX_SECONDS = 60.0
DEFAULT_MAX_BYTES = 200_000_000

_OWN_FUNCTIONS = {*SQL_FUNCTIONS, "cell_id", "cell_lon", "cell_lat"}

# Spark's names for what a read-only SELECT parses into.
_PLAN_NODES = frozenset(
    """Project Filter Aggregate Join LateralJoin Sort GlobalLimit LocalLimit Offset Distinct Union
    Intersect Except SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedRelation UnresolvedWith
    UnresolvedHaving UnresolvedInlineTable OneRowRelation WithWindowDefinition Pivot UnresolvedPivot
    Unpivot Generate Sample LocalRelation""".split()
)
_FUNCTION_GROUPS = frozenset(
    """agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs csv_funcs
    datetime_funcs generator_funcs hash_funcs json_funcs lambda_funcs map_funcs math_funcs predicate_funcs
    string_funcs struct_funcs url_funcs variant_funcs window_funcs""".split()
)
_REFUSED_EXPRESSIONS = frozenset(
    """ExpressionWithUnresolvedIdentifier CurrentUser CurrentDatabase CurrentCatalog SessionUser InputFileName
    ScalarSubqueryReference UnresolvedParameter NamedParameter PosParameter""".split()
)

_PRODUCT = "scala.Product"
_ITERABLE = "scala.collection.Iterable"
_PLAN = "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan"
_EXPRESSION = "org.apache.spark.sql.catalyst.expressions.Expression"


class _Gate:
    """One walk over a parsed statement."""

    def __init__(self, spark: SparkSession, allowed: Sequence[str]):
        self.gateway = spark.sparkContext._gateway
        self.registry = spark._jsparkSession.sessionState().functionRegistry()
        self.identifier = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier
        self.allowed = list(allowed)
        self.relations: set[str] = set()
        self.named_here: set[str] = set()
        self.own_functions: set[str] = set()

    def _is(self, value: JavaObject, type_name: str) -> bool:
        return is_instance_of(self.gateway, value, type_name)

    def _items(self, iterator: JavaObject) -> Iterator:
        while iterator.hasNext():
            yield iterator.next()

    def _strings(self, sequence: JavaObject) -> list[str]:
        return [str(item) for item in self._items(sequence.iterator())]

    def walk(self, root: JavaObject) -> None:
        pending: list[tuple[object, bool]] = [(root, False)]
        while pending:
            value, in_with = pending.pop()
            if not isinstance(value, JavaObject):
                continue
            if self._is(value, _ITERABLE):
                pending += [(item, in_with) for item in self._items(value.iterator())]
                continue
            if not self._is(value, _PRODUCT):
                continue
            name = value.getClass().getSimpleName().rstrip("$")
            if self._is(value, _PLAN):
                self._check_plan(name, value)
            elif self._is(value, _EXPRESSION):
                self._check_expression(name, value)
            pending += [(item, in_with) for item in self._items(value.productIterator())]

    def _check_plan(self, name: str, node: JavaObject) -> None:
        if name == "UnresolvedTableValuedFunction" or name.endswith("TableValuedFunction"):
            raise InvalidRequestError(
                f"table functions are not available; query the datasets by name: {', '.join(self.allowed)}"
            )
        if name not in _PLAN_NODES:
            raise InvalidRequestError(f"only SELECT over the datasets is allowed, and this contains {name}")
        if name == "UnresolvedWith":
            for entry in self._items(node.cteRelations().iterator()):
                self.named_here.add(str(next(self._items(entry.productIterator()))).lower())
        if name == "UnresolvedRelation":
            parts = self._strings(node.multipartIdentifier())
            if len(parts) != 1 or node.isStreaming() or not node.options().isEmpty():
                raise InvalidRequestError(
                    f"unknown table {'.'.join(parts)!r}; query the datasets by name: {', '.join(self.allowed)}"
                )
            self.relations.add(parts[0])

    def _check_expression(self, name: str, node: JavaObject) -> None:
        if name in _REFUSED_EXPRESSIONS:
            raise InvalidRequestError(f"{name} is not available here")
        if name == "UnresolvedAttribute":
            if any(part.lower() == "_metadata" for part in self._strings(node.nameParts())):
                raise InvalidRequestError("file metadata is not available here")
        if name == "UnresolvedFunction":
            parts = self._strings(node.nameParts())
            self._check_function(parts)

    def _check_function(self, parts: list[str]) -> None:
        function = parts[-1].lower()
        if len(parts) == 1 and function in _OWN_FUNCTIONS:
            self.own_functions.add(function)
            return
        if function.startswith("h3_"):
            raise CapabilityUnavailableError(f"{function} is not available; use cell_id, cell_lon and cell_lat")
        found = self.registry.lookupFunction(self.identifier(function)) if len(parts) == 1 else None
        if found is None or not found.isDefined() or found.get().getGroup() not in _FUNCTION_GROUPS:
            raise InvalidRequestError(f"the function {'.'.join(parts)} is not available here")

    def tables(self) -> list[str]:
        """The datasets referenced; a name that is neither one nor defined by WITH fails."""
        known = {name.lower(): name for name in self.allowed}
        used = set()
        for relation in self.relations:
            if relation.lower() in known:
                used.add(known[relation.lower()])
            elif relation.lower() not in self.named_here:
                raise InvalidRequestError(
                    f"unknown table {relation!r}; query the datasets by name: {', '.join(self.allowed)}"
                )
        return sorted(used)


def check_sql(spark: SparkSession, catalog: Catalog, sql: str) -> tuple[str, list[str], bool]:
    """(text, datasets it reads, whether it calls the spatial functions), or an error."""
    text, names, gate, _ = _checked(spark, catalog, sql)
    return text, names, bool(gate.own_functions)


def _checked(spark: SparkSession, catalog: Catalog, sql: str) -> tuple[str, list[str], _Gate, JavaObject]:
    text = sql.strip().rstrip(";").strip()
    if not text:
        raise InvalidRequestError("the SQL text is empty; pass one SELECT statement")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as exc:
        if isinstance(exc, ParseException) or "ParseException" in str(exc):
            raise InvalidRequestError(
                f"cannot parse this as exactly one statement: {str(exc).splitlines()[0]}"
            ) from exc
        raise
    gate = _Gate(spark, [name for name in catalog.names if name.isidentifier()])
    gate.walk(plan)
    return text, gate.tables(), gate, plan


def run_sql(
    spark: SparkSession, catalog: Catalog, sql: str, max_rows: int | None = None, max_seconds: float | None = None
) -> DataFrame:
    """The result of one read-only SELECT; with `max_rows`, cut to that whatever it asks for.

    Only the datasets it names are bound, and only while Spark analyses the text; temp
    views of the same name are put back afterwards. Spatial predicates go through tiles and
    rectangles (`tessera.plans.spatialjoin`); a join first asks for its polygons' levels and rectangle, a
    small query that `max_seconds` bounds.
    """
    text, names, gate, plan = _checked(spark, catalog, sql)
    if max_rows is not None and max_rows < 1:
        raise InvalidRequestError(f"max_rows must be at least 1, got {max_rows}")
    if gate.own_functions:
        register_functions(spark)
    temp_view = spark._jsparkSession.sessionState().catalog().getTempView
    replaced = {name: spark.table(name) for name in names if temp_view(name).isDefined()}
    try:
        catalog.register_views(spark, names)
        if gate.own_functions & {"st_contains", "st_intersects"}:
            register_join_functions(spark)
            collect = collect_within if max_seconds is None else lambda df: collect_within(df, max_seconds)
            text = SpatialRewrite(spark, catalog, text, plan, gate.named_here).apply(collect)
        result = spark.sql(text)
    finally:
        for name in names:
            if name in replaced:
                replaced[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)
    return result if max_rows is None else result.limit(max_rows)


# -- time and byte ceilings -----------------------------------------------------------

_ADVICE = (
    "it probably reads every row group: a row group is skipped only on comparisons of "
    "bbox.xmin/xmax/ymin/ymax with numbers. Add the four comparisons of a rectangle, or of "
    "several joined by OR or UNION ALL, or use a typed operation"
)


def collect_within(df: DataFrame, max_seconds: float = DEFAULT_MAX_SECONDS) -> list[Row]:
    """Collect a bounded result, cancelling its Spark jobs at the deadline."""
    if max_seconds <= 0:
        raise QueryTimeoutError(f"the query was stopped after {max_seconds:g} s; {_ADVICE}")
    context, tag = df.sparkSession.sparkContext, f"tessera-{uuid.uuid4().hex}"
    done, late = threading.Event(), threading.Event()

    def watch() -> None:
        if done.wait(max_seconds):
            return
        late.set()
        # A job may start after a cancellation, so it is repeated until the query is gone.
        while not done.wait(0.1):
            context.cancelJobsWithTag(tag)

    threading.Thread(target=watch, daemon=True).start()
    context.addJobTag(tag)
    try:
        return df.collect()
    except Exception as exc:
        if late.is_set():
            raise QueryTimeoutError(f"the query was stopped after {max_seconds:g} s; {_ADVICE}") from exc
        raise
    finally:
        done.set()
        context.removeJobTag(tag)


# Spark's names for the filters it hands to a scan.
_OPERATORS = {"LessThanOrEqual": "<=", "LessThan": "<", "GreaterThanOrEqual": ">=", "GreaterThan": ">", "EqualTo": "=", "EqualNullSafe": "="}


def _filter_of(pushed: JavaObject) -> Filter:
    """A pushed filter as a tree; None for one that statistics cannot judge."""
    name = pushed.getClass().getSimpleName()
    if name in ("And", "Or"):
        return name.lower(), [_filter_of(pushed.left()), _filter_of(pushed.right())]
    if name == "Not":
        return "not", _filter_of(pushed.child())
    if name in _OPERATORS:
        return pushed.attribute(), _OPERATORS[name], pushed.value()
    if name == "In":
        return pushed.attribute(), "in", list(pushed.values())
    return None


def _leaf_paths(data_type: T.DataType, prefix: str = "") -> Iterator[str]:
    for field in data_type.fields:
        path = f"{prefix}{field.name}"
        if isinstance(field.dataType, T.StructType):
            yield from _leaf_paths(field.dataType, path + ".")
        else:
            yield path


def file_scans(df: DataFrame) -> list[dict]:
    """Root paths, columns, pushed filter and, of it, the comparisons that all must hold, of each Parquet scan of a plan."""
    plan = df._jdf.queryExecution().executedPlan()
    if "Adaptive" in plan.getClass().getSimpleName():
        plan = plan.initialPlan()
    plans, scans = [plan], []
    subqueries = plan.subqueriesAll().iterator()
    while subqueries.hasNext():
        inner = subqueries.next()
        inner = inner.child() if inner.getClass().getSimpleName() == "SubqueryExec" else inner
        plans.append(inner.initialPlan() if "Adaptive" in inner.getClass().getSimpleName() else inner)
    for each in plans:
        leaves = each.collectLeaves().iterator()
        while leaves.hasNext():
            leaf = leaves.next()
            if leaf.getClass().getSimpleName() != "FileSourceScanExec":
                continue
            roots = leaf.relation().location().rootPaths().iterator()
            paths = []
            while roots.hasNext():
                paths.append(roots.next().toString())
            pushed, filters = leaf.pushedDownFilters().iterator(), []
            while pushed.hasNext():
                filters.append(_filter_of(pushed.next()))
            comparisons = [f for f in filters if f and f[0] not in ("and", "or", "not") and f[1] != "in"]
            schema = T.StructType.fromJson(json.loads(leaf.requiredSchema().json()))
            scans.append({"paths": paths, "columns": list(_leaf_paths(schema)), "comparisons": comparisons, "filter": ("and", filters)})
    return scans


def query_cost(df: DataFrame, footers_of: Callable[[list[str]], DataFrame] | None = None) -> DataFrame:
    """One row per Parquet scan of a query: what it will read, from footers, before it runs.

    `footers_of` gives the footer table for a scan's root paths; without it the footers are
    read now.
    """
    spark = df.sparkSession
    total: DataFrame | None = None
    for scan in file_scans(df):
        table = footers_of(scan["paths"]) if footers_of else footers(spark, *scan["paths"])
        report = scan_report(table, scan["columns"], scan["filter"])
        total = report if total is None else total.unionByName(report)
    if total is None:
        raise InvalidRequestError("the query reads no Parquet file")
    return total
