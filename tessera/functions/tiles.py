"""Polygons cut into grid tiles, each with just the edges that decide a point inside it.

Level k of the grid has square cells of 360 / 4^k degrees. A polygon is laid on the
finest level whose cost (tiles plus edge copies) stays within ``16 + 4 * edges``, so the
tile table is linear in the polygons' size, large plain areas get few tiles and detailed
coasts get small ones. A tile holds

* the edges whose own rectangle touches the tile;
* one artificial far-eastern edge per vertex where the boundary leaves the part of the
  polygon lying east of the tile's column. Between two such vertices the boundary east of
  the column contributes to the crossing parity only through the vertices' heights, and
  every vertex with both edges east of the column cancels out;
* one artificial edge for what is left of that contribution, when it is odd.

The parity of an eastward ray over a tile's edges therefore equals the parity over all the
polygon's edges, for every point of the tile and without any rounding. A tile with no edge
of its own is wholly inside (kept, with no edges) or wholly outside (dropped).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import geometry as geo
from tessera.functions.boxes import BoundingBox

MAX_LEVEL = 12
# Edges per row of the tile table; a tile with more is spread over several rows.
EDGES_PER_ROW = 2048

_LEVEL_SHIFT, _X_SHIFT = 50, 25
_FAR = 1e6

# Edges are one flat list ax, ay, bx, by, ax, ...: the cheapest nested value to move.
TILE_FIELDS = "tile bigint, level int, chunk int, chunks int, edges array<double>"
_TILE_ARROW = [
    pa.field("tile", pa.int64()),
    pa.field("level", pa.int32()),
    pa.field("chunk", pa.int32()),
    pa.field("chunks", pa.int32()),
    pa.field("edges", pa.list_(pa.float64())),
]
_ROWS_PER_BATCH = 20_000


def _scale(level: int) -> float:
    return 4.0**level / 360.0


def _cells(values: np.ndarray, origin: float, level: int) -> np.ndarray:
    cell = np.floor((values + origin) * _scale(level)).astype("i8")
    return np.clip(cell, 0, 4**level)


def tile_key(x: Column, y: Column, level: int) -> Column:
    """The tile of a point, by the same arithmetic as `_cells`."""

    def axis(value: Column, origin: float) -> Column:
        cell = F.floor((value + F.lit(origin)) * F.lit(_scale(level)))
        return F.greatest(F.lit(0).cast("bigint"), F.least(cell, F.lit(4**level).cast("bigint")))

    return (
        F.lit(level << _LEVEL_SHIFT).cast("bigint")
        + F.shiftleft(axis(x, 180.0), _X_SHIFT)
        + axis(y, 90.0)
    )


def _choose_level(ax, ay, bx, by) -> int:
    budget = 16 + 4 * len(ax)

    def spans(a, b, origin, level):
        low, high = (_cells(f(a, b), origin, level) for f in (np.minimum, np.maximum))
        return int(high.max() - low.min()) + 1, high - low + 1

    # The envelope alone gives an upper bound on the level without touching the edges.
    wide, tall = float(np.ptp([ax, bx])), float(np.ptp([ay, by]))
    level = MAX_LEVEL
    while level and (wide * _scale(level)) * (tall * _scale(level)) > budget:
        level -= 1
    while level:
        columns, across = spans(ax, bx, 180.0, level)
        rows, up = spans(ay, by, 90.0, level)
        if columns * rows + int((across * up).sum()) <= budget:
            break
        level -= 1
    return level


def tile_key_sql(x: str, y: str, level: int) -> str:
    """`tile_key` as SQL text over two expressions."""

    def axis(value: str, origin: float) -> str:
        cell = f"floor(({value} + {origin!r}D) * {_scale(level)!r}D)"
        return f"greatest(0L, least(cast({cell} AS bigint), {4**level}L))"

    return f"({level << _LEVEL_SHIFT}L + shiftleft({axis(x, 180.0)}, {_X_SHIFT}) + {axis(y, 90.0)})"


def level_of(rings: list[np.ndarray]) -> int:
    """The level on which `cut` lays a polygon."""
    closed = [geo.closed(ring) for ring in rings]
    edges = np.concatenate([np.hstack([ring[:-1], ring[1:]]) for ring in closed])
    return _choose_level(*edges.T)


def cut(rings: list[np.ndarray]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(level, tile keys, edge counts, edges) of one polygon; edges are grouped by tile."""
    edges, previous, start = [], [], 0
    for ring in map(geo.closed, rings):
        n = len(ring) - 1
        edges.append(np.hstack([ring[:-1], ring[1:]]))
        previous.append(start + (np.arange(n) - 1) % n)
        start += n
    edges, previous = np.concatenate(edges), np.concatenate(previous)
    ax, ay, bx, by = edges.T
    level = _choose_level(ax, ay, bx, by)
    c0, c1 = (_cells(f(ax, bx), 180.0, level) for f in (np.minimum, np.maximum))
    r0, r1 = (_cells(f(ay, by), 90.0, level) for f in (np.minimum, np.maximum))
    west, south = c0.min(), r0.min()
    columns, rows = int(c1.max() - west + 1), int(r1.max() - south + 1)
    c0, c1, r0, r1 = c0 - west, c1 - west, r0 - south, r1 - south

    # Own edges, copied to every tile their rectangle touches.
    width = c1 - c0 + 1
    copies = width * (r1 - r0 + 1)
    owner = np.repeat(np.arange(len(edges)), copies)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(copies) - copies, copies)
    own_tile = (r0[owner] + nth // width[owner]) * columns + c0[owner] + nth % width[owner]

    # Vertices at which exactly one of the two edges lies east of a column.
    low, high = np.minimum(c0, c0[previous]), np.maximum(c0, c0[previous])
    spans = high - low
    vertex = np.repeat(np.arange(len(edges)), spans)
    nth = np.arange(len(vertex)) - np.repeat(np.cumsum(spans) - spans, spans)
    turn_column = low[vertex] + nth
    turn_row = (_cells(ay, 90.0, level) - south)[vertex]
    turns = np.column_stack([np.full(len(vertex), _FAR), ay[vertex], np.full(len(vertex), _FAR), np.full(len(vertex), -_FAR)])
    turn_tile = turn_row * columns + turn_column
    flips = np.zeros((rows, columns), "i8")
    np.add.at(flips, (turn_row, turn_column), 1)
    above = flips[::-1].cumsum(axis=0)[::-1] - flips
    odd = (above % 2 == 1).ravel()

    has_edges = np.zeros(rows * columns, bool)
    has_edges[own_tile] = True
    odd_tile = np.flatnonzero(odd & has_edges)
    constant = np.tile([_FAR, _FAR, _FAR, -_FAR], (len(odd_tile), 1))

    all_tiles = np.concatenate([own_tile, turn_tile, odd_tile])
    order = np.argsort(all_tiles, kind="stable")
    all_edges = np.concatenate([edges[owner], turns, constant])[order]
    bordered, counts = np.unique(all_tiles, return_counts=True)
    inside = np.flatnonzero(odd & ~has_edges)
    tiles = np.concatenate([bordered, inside])
    counts = np.concatenate([counts, np.zeros(len(inside), "i8")])
    keys = (
        (level << _LEVEL_SHIFT)
        + ((tiles % columns + west) << _X_SHIFT)
        + tiles // columns
        + south
    )
    return level, keys, counts, all_edges


def _near(keys: np.ndarray, level: int, box: BoundingBox) -> np.ndarray:
    """Tiles at most one cell away from a rectangle: the slack covers points whose stored
    rectangle was rounded."""
    mask = (1 << _X_SHIFT) - 1
    column, row = (keys >> _X_SHIFT) & mask, keys & mask
    x = _cells(np.array([box.min_lon, box.max_lon]), 180.0, level)
    y = _cells(np.array([box.min_lat, box.max_lat]), 90.0, level)
    return (column >= x[0] - 1) & (column <= x[1] + 1) & (row >= y[0] - 1) & (row <= y[1] + 1)


def cut_batches(
    batches: Iterator[pa.RecordBatch],
    geometry: str,
    edges_per_row: int = EDGES_PER_ROW,
    box: BoundingBox | None = None,
) -> Iterator[pa.RecordBatch]:
    """The tiles of every polygon in a stream of batches; other columns are repeated."""
    for batch in batches:
        where = batch.schema.get_field_index(geometry)
        kept = [i for i in range(batch.num_columns) if i != where]
        fields = [batch.schema.field(i) for i in kept] + _TILE_ARROW
        out: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            row, level, tile, chunk, chunks, lengths, edges = zip(*out)
            held = [len(t) for t in tile]
            offsets = np.concatenate([[0], 4 * np.cumsum(np.concatenate(lengths))])
            columns = [batch.column(i).take(pa.array(np.repeat(row, held))) for i in kept]
            columns += [
                pa.array(np.concatenate(tile)),
                pa.array(np.repeat(level, held), pa.int32()),
                pa.array(np.concatenate(chunk), pa.int32()),
                pa.array(np.concatenate(chunks), pa.int32()),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(edges).ravel())),
            ]
            return pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

        for row, value in enumerate(batch.column(where)):
            if not value.is_valid:
                continue
            rings = [r for polygon in geo.polygons(geo.from_wkb(value.as_py())) for r in polygon if len(r)]
            if not rings:
                continue
            level, keys, counts, edges = cut(rings)
            if box is not None:
                near = _near(keys, level, box)
                edges = edges[np.repeat(near, counts)]
                keys, counts = keys[near], counts[near]
            if not len(keys):
                continue
            chunks = np.maximum(1, -(-counts // edges_per_row))
            first = np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)
            lengths = np.minimum(np.repeat(counts, chunks) - first * edges_per_row, edges_per_row)
            out.append((row, level, np.repeat(keys, chunks), first, np.repeat(chunks, chunks), lengths, edges))
            size += len(lengths) + len(edges)
            if size > _ROWS_PER_BATCH:
                yield flush()
                out, size = [], 0
        if out:
            yield flush()


def tile_of(xy: np.ndarray, level: int) -> np.ndarray:
    """`tile_key` for an array of points."""
    return (level << _LEVEL_SHIFT) + (_cells(xy[:, 0], 180.0, level) << _X_SHIFT) + _cells(xy[:, 1], 90.0, level)


def covered_tiles(low: Column, high: Column) -> Column:
    """Every tile of the rectangle whose south-west and north-east tiles are given."""
    mask = F.lit((1 << _X_SHIFT) - 1).cast("bigint")

    def column(tile: Column) -> Column:
        return F.shiftright(tile, _X_SHIFT)

    def row(tile: Column) -> Column:
        return tile.bitwiseAND(mask)

    # The level stays in the high bits of a column's number.
    return F.flatten(
        F.transform(
            F.sequence(column(low), column(high)),
            lambda c: F.transform(F.sequence(row(low), row(high)), lambda r: F.shiftleft(c, _X_SHIFT) + r),
        )
    )


def contained_in_tiles(inner: geo.Geometry, level: int, tiles: list[int], edges: list[list[float]]) -> bool:
    """`geometry.contains` for a polygon known by the tiles around `inner`."""
    own: dict[int, np.ndarray] = {}
    for tile, flat in zip(tiles, edges):
        part = np.asarray(flat, "f8").reshape(-1, 4)
        own[tile] = np.concatenate([own[tile], part]) if tile in own else part

    def place(xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        odd, on = np.zeros(len(xy), bool), np.zeros(len(xy), bool)
        keys = tile_of(xy, level)
        for key in set(keys.tolist()) & own.keys():
            at = keys == key
            if len(own[key]):
                odd[at], on[at] = geo.locate(xy[at, 0], xy[at, 1], own[key])
            else:
                odd[at] = True
        return odd, on

    near = np.concatenate([np.empty((0, 4)), *own.values()])
    near = np.unique(near[near[:, 0] < _FAR], axis=0)
    return geo.contained_in(inner, near, place)


def crossings(x: np.ndarray, y: np.ndarray, edges: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(crossings of an eastward ray, edges the point is on) per row of a batch.

    Each row is a point with its own flat edge list; the whole batch is one vector
    computation over all the lists, summed up per row.
    """
    if isinstance(edges, pa.ChunkedArray):
        edges = edges.combine_chunks()
    offsets = np.asarray(edges.offsets) // 4
    flat = np.asarray(edges.values)[4 * offsets[0] : 4 * offsets[-1]].reshape(-1, 4)
    counts = np.diff(offsets)
    crossed = np.zeros(len(counts), "i8")
    touched = np.zeros(len(counts), "i8")
    if not len(flat):
        return crossed, touched
    px, py = np.repeat(x, counts), np.repeat(y, counts)
    ax, ay, bx, by = np.ascontiguousarray(flat.T)
    side = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
    hits = ((ay > py) != (by > py)) & ((side > 0) == (by > ay))
    row = np.repeat(np.arange(len(counts)), counts)
    crossed += np.bincount(row[hits], minlength=len(counts))
    flat_on = np.flatnonzero(side == 0)
    if len(flat_on):
        ax, ay, bx, by, px, py = (v[flat_on] for v in (ax, ay, bx, by, px, py))
        on = (np.minimum(ax, bx) <= px) & (px <= np.maximum(ax, bx))
        on &= (np.minimum(ay, by) <= py) & (py <= np.maximum(ay, by))
        touched += np.bincount(row[flat_on[on]], minlength=len(counts))
    return crossed, touched
