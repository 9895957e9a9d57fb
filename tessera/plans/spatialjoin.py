"""Spatial joins and shape tests in free SQL, on the same tiles and rectangles as the typed operations.

A predicate of two datasets, such as ``ON st_contains(z.geometry, p.geometry)``, has no equality
in it, so Spark could only compare every row with every row. Here it becomes one: the polygons
are read with the tiles they are cut into, the points with the tile they lie in, and the predicate
turns into equal tiles and a test of the few edges stored with the tile. A polygon lies on one
level and a point in one tile of it, so each pair is met once, and the result is that of the
text. Where most shapes belong to several polygons, points meet each shape once and the polygons join by its digest. The polygons' common rectangle, after their own conditions in the statement, prunes the points' scan. A test
against a literal shape gets the comparisons of its rectangle beside it.

Only the text changes, at the places Spark's parser reports; Spark analyses and plans it as
any other. What does not have the form stays as it was written: outer joins, predicates under OR or
NOT, two polygon datasets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import geometry as geo
from tessera.functions.boxes import BoundingBox
from tessera.functions.spatial import Shape, points_only_xy
from tessera.functions.tiles import cut, level_of, tile_key_sql
from tessera.sources.catalog import Catalog, Source

#: Degrees by which the polygons' rectangle is widened: stored rectangles may be 32-bit floats.
SLACK = 1e-4

_PLAN = "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan"
_EXPRESSION = "org.apache.spark.sql.catalyst.expressions.Expression"
_PREDICATES = ("st_contains", "st_intersects")
#: Spark's functions whose value differs from call to call.
_CHANCE = frozenset("rand random randn randstr uniform uuid shuffle monotonically_increasing_id".split())


# -- functions that only rewritten statements call -------------------------------------


def _rings(value: pa.Scalar) -> list:
    return [r for polygon in geo.polygons(geo.from_wkb(value.as_py())) for r in polygon if len(r)] if value.is_valid else []


_TILES = T.ArrayType(T.StructType([T.StructField("tile", T.LongType()), T.StructField("edges", T.ArrayType(T.DoubleType()))]))


@F.arrow_udf(_TILES)
def _tiles(wkb: pa.Array) -> pa.Array:
    """Tiles of a polygon with the edges that decide a point in them, all edges of a tile together."""
    out = []
    for value in wkb:
        rings = _rings(value)
        if not rings:
            out.append(None)
            continue
        _, keys, counts, edges = cut(rings)
        ends = counts.cumsum()
        flat = edges.reshape(len(edges), 4)
        out.append([{"tile": int(k), "edges": flat[e - n : e].ravel()} for k, n, e in zip(keys, counts, ends, strict=True)])
    kind = pa.list_(pa.struct([("tile", pa.int64()), ("edges", pa.list_(pa.float64()))]))
    return pa.array(out, kind)


@F.arrow_udf(T.IntegerType())
def _level(wkb: pa.Array) -> pa.Array:
    rings = map(_rings, wkb)
    return pa.array([level_of(r) if r else None for r in rings], pa.int32())


def _functions() -> dict:
    from tessera.operators.containment import _in_or_on, _inside_tile

    return {
        "__st_tiles": _tiles, "__st_level": _level, "__st_point": points_only_xy,
        "__st_contains": _inside_tile, "__st_intersects": _in_or_on,
    }


# -- what the parsed statement says -----------------------------------------------------


@dataclass
class _Relation:
    """A dataset in a FROM clause: its alias, place in the text and what is done to it."""

    alias: str
    source: Source
    start: int
    stop: int
    text: str
    hidden: list[str] = field(default_factory=list)
    rectangles: list[str] = field(default_factory=list)


@dataclass
class _Scope:
    """One FROM clause of inner joins: datasets, other members, conditions and stars above it."""

    relations: list[_Relation] = field(default_factory=list)
    others: int = 0
    conditions: list[JavaObject] = field(default_factory=list)
    stars: list[JavaObject] = field(default_factory=list)
    nested_star: bool = False


class SpatialRewrite:
    """The statement's text with its spatial predicates put on tiles."""

    def __init__(self, spark: SparkSession, catalog: Catalog, text: str, plan: JavaObject, shadowed: set[str]):
        self.spark, self.catalog, self.sql = spark, catalog, text
        self.gateway = spark.sparkContext._gateway
        self.shadowed = shadowed
        self.scopes: list[_Scope] = []
        self.changes: dict[tuple[int, int], str] = {}
        self.number = 0
        self._visit(plan, None)

    # -- reading the plan

    def _is(self, value: object, name: str) -> bool:
        return isinstance(value, JavaObject) and is_instance_of(self.gateway, value, name)

    def _name(self, node: JavaObject) -> str:
        return node.getClass().getSimpleName().rstrip("$")

    def _parts(self, node: JavaObject) -> Iterator[JavaObject]:
        """Nodes right below a node, whatever holds them."""
        pending = [node.productIterator()]
        while pending:
            iterator = pending.pop()
            while iterator.hasNext():
                value = iterator.next()
                if self._is(value, _PLAN) or self._is(value, _EXPRESSION):
                    yield value
                elif self._is(value, "scala.collection.Iterable"):
                    pending.append(value.iterator())
                elif self._is(value, "scala.Option") or self._is(value, "scala.Product"):
                    pending.append(value.productIterator())

    def _all(self, node: JavaObject) -> Iterator[JavaObject]:
        pending = [node]
        while pending:
            each = pending.pop()
            yield each
            pending += self._parts(each)

    def _span(self, node: JavaObject) -> tuple[int, int] | None:
        origin = node.origin()
        if not (origin.startIndex().isDefined() and origin.stopIndex().isDefined()):
            return None
        return origin.startIndex().get(), origin.stopIndex().get() + 1

    def _text(self, node: JavaObject) -> str:
        start, stop = self._span(node)
        return self.sql[start:stop]

    def _verbatim(self, node: JavaObject) -> str | None:
        """The text of an expression, if what the parser reports about it can be parsed to the same again.

        An operator such as IN is reported without its left side, so the parts' places count too.
        """
        spans = [span for each in self._all(node) if (span := self._span(each))]
        if not spans:
            return None
        text = self.sql[min(s for s, _ in spans) : max(e for _, e in spans)]
        try:
            again = self.spark._jsparkSession.sessionState().sqlParser().parseExpression(text)
        except Exception as exc:
            if isinstance(exc, ParseException) or "ParseException" in str(exc):
                return None
            raise
        return text if again.toString() == node.toString() else None

    def _strings(self, sequence: JavaObject) -> list[str]:
        iterator, out = sequence.iterator(), []
        while iterator.hasNext():
            out.append(str(iterator.next()))
        return out

    def _visit(self, node: JavaObject, above: _Scope | None) -> None:
        """Finds the FROM clauses; `above` holds the stars and conditions that belong to the one below."""
        name = self._name(node)
        scope = above
        if name in ("Project", "Aggregate"):
            scope = _Scope()
            for item in self._parts(node):
                if not self._is(item, _EXPRESSION):
                    continue
                kind = self._name(item)
                if kind == "UnresolvedStar":
                    scope.stars.append(item)
                elif any("Star" in self._name(each) for each in self._all(item)):
                    scope.nested_star = True
        elif name == "Filter":
            scope = scope or _Scope(nested_star=True)
            scope.conditions.append(node.condition())
        elif name in ("Join", "SubqueryAlias", "UnresolvedRelation"):
            found = scope or _Scope(nested_star=True)
            self._from(node, found)
            if found.relations:
                self.scopes.append(found)
            return
        for part in self._parts(node):
            self._visit(part, scope if name in ("Project", "Aggregate", "Filter") and self._is(part, _PLAN) else None)

    def _from(self, node: JavaObject, scope: _Scope) -> None:
        name = self._name(node)
        if name == "Join" and self._name(node.joinType()) in ("Inner", "Cross"):
            self._from(node.left(), scope)
            self._from(node.right(), scope)
            if node.condition().isDefined():
                scope.conditions.append(node.condition().get())
            return
        relation, alias = node, None
        if name == "SubqueryAlias" and self._name(node.child()) == "UnresolvedRelation":
            relation, alias = node.child(), str(node.identifier().name())
        if self._name(relation) == "UnresolvedRelation":
            table = self._strings(relation.multipartIdentifier())[-1]
            known = {n.lower(): n for n in self.catalog.names}
            span = self._span(node)
            if table.lower() in known and table.lower() not in self.shadowed and span:
                source = self.catalog.get(known[table.lower()])
                scope.relations.append(_Relation(alias or table, source, *span, self.sql[span[0] : span[1]]))
                return
        scope.others += 1
        for part in self._parts(node):
            self._visit(part, None)

    # -- predicates

    def _conjuncts(self, node: JavaObject) -> Iterator[JavaObject]:
        if self._name(node) == "And":
            for side in (node.left(), node.right()):
                yield from self._conjuncts(side)
        else:
            yield node

    def _owner(self, node: JavaObject, scope: _Scope) -> _Relation | None:
        """The one dataset whose columns an expression reads, if there is exactly one."""
        aliases = {r.alias.lower(): r for r in scope.relations}
        if len(aliases) < len(scope.relations):
            return None
        owners = set()
        for each in self._all(node):
            if self._is(each, _PLAN):
                return None
            if self._name(each) == "UnresolvedAttribute":
                parts = self._strings(each.nameParts())
                if len(parts) > 1 and parts[0].lower() in aliases:
                    owners.add(parts[0].lower())
                elif len(scope.relations) == 1 and not scope.others:
                    owners.add(next(iter(aliases)))
                else:
                    return None
        return aliases[owners.pop()] if len(owners) == 1 else None

    def _constant(self, node: JavaObject) -> bool:
        return all(self._name(each) in ("UnresolvedFunction", "Literal") for each in self._all(node))

    def _geometry_of(self, node: JavaObject, relation: _Relation) -> bool:
        if self._name(node) != "UnresolvedAttribute" or not relation.source.geometry_column:
            return False
        return self._strings(node.nameParts())[-1].lower() == relation.source.geometry_column.lower()

    def _called(self, node: JavaObject) -> tuple[str, list[JavaObject]]:
        if self._name(node) != "UnresolvedFunction":
            return "", []
        iterator, arguments = node.arguments().iterator(), []
        while iterator.hasNext():
            arguments.append(iterator.next())
        return self._strings(node.nameParts())[-1].lower(), arguments

    def _is_point(self, node: JavaObject, relation: _Relation) -> bool:
        return self._called(node)[0] == "st_point" or self._geometry_of(node, relation) and not relation.source.polygonal

    def apply(self, rows: Callable[[DataFrame], list]) -> str:
        """The new text. `rows` collects the small result that says which levels the polygons use."""
        for scope in self.scopes:
            conditions = [c for whole in scope.conditions for c in self._conjuncts(whole)]
            spatial = [(c, *called) for c in conditions if (called := self._called(c))[0] in _PREDICATES and self._span(c)]
            for condition, _, arguments in spatial:
                self._literal(scope, condition, arguments)
            for condition, name, arguments in spatial:
                if len(arguments) == 2 and self._span(condition) not in self.changes:
                    self._joined(scope, condition, name, arguments, conditions, rows)
            self._hide(scope)
        out, at = [], 0
        for (start, stop), text in sorted(self.changes.items()):
            out += [self.sql[at:start], text]
            at = stop
        return "".join([*out, self.sql[at:]])

    def _hide(self, scope: _Scope) -> None:
        """Stars leave the added columns out."""
        for star in scope.stars:
            span, text = self._span(star), self._text(star)
            target = text.rpartition(".")[0].strip("` ").lower()
            hidden = [h for r in scope.relations if target in ("", r.alias.lower()) for h in r.hidden]
            if hidden:
                self.changes[span] = f"{text} EXCEPT ({', '.join(hidden)})"
        for relation in scope.relations:
            if relation.hidden:
                self.changes[relation.start, relation.stop] = relation.text

    def _rectangle(self, relation: _Relation, box: BoundingBox, alias: str) -> str:
        quoted = f"`{alias}`.{relation.source.bbox_column}"
        return " AND ".join(f"{path} {op} {value!r}D" for path, op, value in box.comparisons(quoted))

    def _own(self, relation: _Relation, scope: _Scope, conditions: list[JavaObject]) -> list[str]:
        """Conditions on one dataset alone, to be applied to it before anything else as well."""
        out = list(relation.rectangles)
        for condition in conditions:
            called = {self._called(each)[0] for each in self._all(condition)}
            if called & (_CHANCE | set(_PREDICATES)) or self._owner(condition, scope) is not relation:
                continue
            text = self._verbatim(condition)
            out += [f"({text})"] if text else []
        return out

    def _literal(self, scope: _Scope, condition: JavaObject, arguments: list[JavaObject]) -> None:
        """A dataset's geometry against ``st_geomfromtext('...')``: its rectangle is added."""
        fixed = [a for a in arguments if self._constant(a)]
        other = [a for a in arguments if not self._constant(a)]
        if len(fixed) != 1 or len(other) != 1:
            return
        name, inner = self._called(fixed[0])
        relation = self._owner(other[0], scope)
        if name != "st_geomfromtext" or self._name(inner[0]) != "Literal" or not relation or not relation.source.bbox_column:
            return
        if not self._geometry_of(other[0], relation):
            return
        rectangle = self._rectangle(relation, Shape(str(inner[0].value())).box, relation.alias)
        relation.rectangles.append(rectangle)
        self.changes[self._span(condition)] = f"({rectangle} AND {self._text(condition)})"

    def _joined(
        self, scope: _Scope, condition: JavaObject, name: str, arguments: list[JavaObject], conditions: list[JavaObject],
        rows: Callable[[DataFrame], list],
    ) -> None:
        """A polygon dataset against a dataset of points."""
        if scope.nested_star:
            return
        owners = [self._owner(a, scope) for a in arguments]
        sides = [(0, 1)] if name == "st_contains" else [(0, 1), (1, 0)]
        for outer, inner in sides:
            area, point = owners[outer], owners[inner]
            if not area or not point or area is point or not area.source.polygonal:
                continue
            if self._geometry_of(arguments[outer], area) and self._is_point(arguments[inner], point):
                break
        else:
            return
        called, coordinates = self._called(arguments[inner])
        if not all(map(self._verbatim, [*arguments, *coordinates])):
            return
        self.number += 1
        n = self.number
        own = self._own(area, scope, conditions)
        levels, box, repeated = self._facts(area, arguments[outer], own, rows)
        shape, x, y = self._text(arguments[outer]), f"__x_{n}", f"__y_{n}"
        keys = ", ".join(tile_key_sql(x, y, level) for level in levels) or "cast(NULL AS bigint)"
        pruned = self._own(point, scope, conditions)
        if called == "st_point" and len(coordinates) == 2:
            lon, lat = (f"cast({self._verbatim(c)} AS double)" for c in coordinates)
            place = f"{lon} AS {x}, {lat} AS {y}"
            if box:  # plain columns reach the scan as they are
                pruned.append(f"{lon} BETWEEN {box.min_lon!r}D AND {box.max_lon!r}D AND {lat} BETWEEN {box.min_lat!r}D AND {box.max_lat!r}D")
        else:
            place = f"__st_point({self._text(arguments[inner])}) AS __xy_{n}"
            if box and point.source.bbox_column:
                pruned.append(self._rectangle(point, box, point.alias))
        located = f"SELECT `{point.alias}`.*, {place} FROM {point.text}" + (f" WHERE {' AND '.join(pruned)}" if pruned else "")
        if called != "st_point":
            located = f"SELECT * EXCEPT (__xy_{n}), __xy_{n}.x AS {x}, __xy_{n}.y AS {y} FROM ({located})"
        keyed = (
            f"(SELECT `{point.alias}`.*, __k.__tile_{n} FROM ({located}) `{point.alias}` LATERAL VIEW explode(array({keys})) __k AS __tile_{n} "
            f"WHERE abs({x}) < double('infinity') AND abs({y}) < double('infinity')) `{point.alias}`"
        )
        if repeated:
            self._shared(scope, condition, name, area, point, shape, own, keyed)
            return
        point.text = keyed
        point.hidden += [x, y, f"__tile_{n}"]
        area.text = (
            f"(SELECT `{area.alias}`.*, __t.__cell_{n}, __t.__edges_{n} FROM {area.text} "
            f"LATERAL VIEW inline(__st_tiles({shape})) __t AS __cell_{n}, __edges_{n}) `{area.alias}`"
        )
        area.hidden += [f"__cell_{n}", f"__edges_{n}"]
        a, p = f"`{area.alias}`", f"`{point.alias}`"
        self.changes[self._span(condition)] = (
            f"({a}.__cell_{n} = {p}.__tile_{n} AND __{name}({p}.{x}, {p}.{y}, {a}.__edges_{n}))"
        )

    def _shared(
        self, scope: _Scope, condition: JavaObject, name: str, area: _Relation, point: _Relation, shape: str, own: list[str], keyed: str
    ) -> None:
        """Points meet the tiles of the distinct shapes; the polygons of a shape join by its digest afterwards."""
        n, a, p = self.number, f"`{area.alias}`", f"`{point.alias}`"
        where = f" WHERE {' AND '.join(own)}" if own else ""
        distinct = f"SELECT DISTINCT {shape} AS __geometry_{n} FROM {self.sql[area.start : area.stop]}{where}"
        tiles = (
            f"SELECT sha2(__geometry_{n}, 256) AS __shape_{n}, __t.__cell_{n}, __t.__edges_{n} FROM ({distinct}) "
            f"LATERAL VIEW inline(__st_tiles(__geometry_{n})) __t AS __cell_{n}, __edges_{n}"
        )
        point.text = (
            f"(SELECT {p}.* EXCEPT (__x_{n}, __y_{n}, __tile_{n}), __s.__shape_{n} FROM {keyed} JOIN ({tiles}) __s "
            f"ON __s.__cell_{n} = {p}.__tile_{n} AND __{name}({p}.__x_{n}, {p}.__y_{n}, __s.__edges_{n})) {p}"
        )
        point.hidden.append(f"__shape_{n}")
        area.text = f"(SELECT {a}.*, sha2({shape}, 256) AS __is_{n} FROM {area.text}) {a}"
        area.hidden.append(f"__is_{n}")
        self.changes[self._span(condition)] = f"({a}.__is_{n} = {p}.__shape_{n})"

    def _facts(
        self, area: _Relation, shape: JavaObject, own: list[str], rows: Callable[[DataFrame], list]
    ) -> tuple[list[int], BoundingBox | None, bool]:
        """Levels and common rectangle of the polygons that their own conditions leave, and whether most shapes repeat."""
        bbox = area.source.bbox_column
        corners = [f"{f}(`{area.alias}`.{bbox}.{c})" for f, c in (("min", "xmin"), ("min", "ymin"), ("max", "xmax"), ("max", "ymax"))]
        where = f" WHERE {' AND '.join(own)}" if own else ""
        original = self.sql[area.start : area.stop]
        # Polygons per shape first: a level is found once a shape, and counts stay small.
        box = ", ".join(f"{c} AS __{k}" for k, c in enumerate(corners)) if bbox else "NULL AS __0"
        whole = ", ".join(f"{'min' if k < 2 else 'max'}(__{k})" for k in range(4)) if bbox else "NULL"
        shapes = f"SELECT {self._text(shape)} AS __geometry, count(*) AS __same, {box} FROM {original}{where} GROUP BY 1"
        ((levels, same, different, *found),) = rows(
            self.spark.sql(
                f"SELECT sort_array(collect_set(__st_level(__geometry))), coalesce(sum(__same), 0), count(*), {whole} FROM ({shapes})"
            )
        )
        repeated = same >= 2 * different > 0
        if None in found or not bbox:
            return levels, None, repeated
        west, south, east, north = (float(v) for v in found)
        return levels, BoundingBox.envelope(
            max(-180.0, west - SLACK), max(-90.0, south - SLACK), min(180.0, east + SLACK), min(90.0, north + SLACK)
        ), repeated


def register_join_functions(spark: SparkSession) -> None:
    for name, function in _functions().items():
        spark.udf.register(name, function)
