"""Which points and shapes meet one literal shape, through an index of the literal.

The literal's polygons are cut into grid tiles once, on the driver. A point finds its tile by
bisection: in a tile wholly inside there is no edge to test, outside of all tiles there is nothing, and
elsewhere the few edges of the tile decide. The time of a batch does not grow with the literal's edges.
Any other geometry is held against the edges under its own rectangle only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tessera.functions import geometry as geo
from tessera.functions import tiles

#: Tiles of a rectangle up to which they are looked up one by one.
_FEW_TILES = 256


class Locator:
    """The index of one geometry; small enough to travel with a function."""

    def __init__(self, geometry: geo.Geometry):
        keys, counts, edges, self.levels = [], [], [], []
        for polygon in geo.polygons(geometry):
            rings = [ring for ring in polygon if len(ring)]
            if rings:
                level, own, held, flat = tiles.cut(rings)
                keys.append(own)
                counts.append(held)
                edges.append(flat)
                self.levels.append(level)
        self.levels = sorted(set(self.levels))
        self.keys = np.concatenate([np.empty(0, "i8"), *keys])
        counts = np.concatenate([np.empty(0, "i8"), *counts])
        flat = np.concatenate([np.empty((0, 4)), *edges])
        # polygons may share a tile: each keeps a row of its own, and the rows are sorted by tile
        starts = np.append(0, np.cumsum(counts))[:-1]
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.counts = self.keys[order], counts[order]
        self.edges = flat[np.repeat(starts[order] - np.append(0, np.cumsum(self.counts))[:-1], self.counts) + np.arange(self.counts.sum())]
        self.offsets = np.append(0, np.cumsum(self.counts))
        self.lines, self.points = geo.line_edges(geometry), geo.points(geometry)
        self.outline = np.concatenate([self.lines, *(geo.ring_edges(p) for p in geo.polygons(geometry))])
        self.places = np.concatenate([self.points, self.outline[:, :2], self.outline[:, 2:]])

    def touches(self, xy: np.ndarray) -> np.ndarray:
        """Which points lie in or on the shape."""
        hit = np.zeros(len(xy), bool)
        at = np.flatnonzero(np.isfinite(xy).all(axis=1))
        for level in self.levels:
            key = tiles.tile_of(xy[at], level)
            first, last = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
            while (held := first < last).any():  # as often as polygons share a tile
                row, own = first[held], at[held]
                inside = self.counts[row] == 0
                near = np.flatnonzero(~inside)
                if len(near):
                    inside[near] = self._tested(xy[own[near]], row[near])
                hit[own[inside]] = True
                first = first + held
        if len(self.lines):
            hit[at] |= geo.locate(xy[at, 0], xy[at, 1], self.lines)[1]
        if len(self.points):
            known = {tuple(p) for p in self.points.tolist()}
            hit[at] |= np.fromiter((tuple(p) in known for p in xy[at].tolist()), bool, len(at))
        return hit

    def _tested(self, xy: np.ndarray, row: np.ndarray) -> np.ndarray:
        """In or on, by the edges of a row of the index for every point."""
        counts = self.counts[row]
        which = np.repeat(self.offsets[row] - np.append(0, np.cumsum(counts))[:-1], counts) + np.arange(counts.sum())
        lists = pa.ListArray.from_arrays(
            pa.array(np.append(0, 4 * np.cumsum(counts)), pa.int32()), pa.array(self.edges[which].ravel())
        )
        crossed, touched = tiles.crossings(xy[:, 0], xy[:, 1], lists)
        return (crossed % 2 == 1) | (touched > 0)

    def _under(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The literal's own edges whose rectangle meets a rectangle."""
        ax, ay, bx, by = self.outline.T
        near = (np.minimum(ax, bx) <= high[0]) & (np.maximum(ax, bx) >= low[0])
        near &= (np.minimum(ay, by) <= high[1]) & (np.maximum(ay, by) >= low[1])
        return self.outline[near]

    def _plain(self, low: np.ndarray, high: np.ndarray) -> bool | None:
        """Whether a rectangle is wholly inside (or outside) by its tiles alone; None if edges must decide."""
        if len(self.lines) or len(self.points):
            return None
        outside = True
        for level in self.levels:
            a, b = tiles.tile_of(low[None], level)[0], tiles.tile_of(high[None], level)[0]
            mask = (1 << tiles._X_SHIFT) - 1
            across, up = (b >> tiles._X_SHIFT) - (a >> tiles._X_SHIFT) + 1, (b & mask) - (a & mask) + 1
            if across * up > _FEW_TILES:
                return None
            column, line = np.divmod(np.arange(across * up), up)
            key = a + (column << tiles._X_SHIFT) + line
            first, last = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
            if ((first < last) & (self.counts[np.minimum(first, len(self.counts) - 1)] == 0)).all():
                return True
            outside &= bool((first == last).all())
        return False if outside else None

    def meets(self, other: geo.Geometry) -> bool:
        """Whether any geometry shares a point with the shape."""
        xy = geo.vertices(other)
        if not len(xy):
            return False
        low, high = xy.min(axis=0), xy.max(axis=0)
        plain = self._plain(low, high)
        if plain is not None:
            return plain
        starts = [geo.points(other), *(l[:1] for l in geo.lines(other)), *(p[0][:1] for p in geo.polygons(other))]
        if self.touches(np.concatenate(starts)).any():
            return True
        near = self._under(low, high)
        own = [geo.line_edges(other), *(geo.ring_edges(p) for p in geo.polygons(other))]
        if len(near) and any(geo._meeting(near, edges) for edges in own if len(edges)):
            return True
        # no boundaries meet: what is left is a part of the literal wholly inside the other
        inside = ((self.places >= low) & (self.places <= high)).all(axis=1)
        return bool(geo.touches_points(self.places[inside], other).any())
