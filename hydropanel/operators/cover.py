"""Polygons as cells of several sizes, for point-in-polygon joins.

A polygon is cut into square cells whose sizes are ``unit`` times powers of ``SPLIT``. A cell that no edge touches lies inside as a whole (or outside,
and is left out); a cell with few edges carries these edges and nothing else of the polygon; a cell with more edges is cut into
``SPLIT`` x ``SPLIT`` smaller ones. So the rows of a polygon grow with its border, whatever its area, and a point is tested against a few edges.

The test is the even-odd rule of ``geo.in_polygon``, to the last bit. Along the ray to the right of a point only crossings up to the cell's right side are
counted; whether the point on that side is inside follows from the side's lower end (``base``) and from where touching
edges cross the side in between, see ``_Edges.inside`` and ``zones.inside``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

SPLIT = 8
EDGES = 16
DEEPEST = -2
_CELL = "level int, cx long, cy long, inner boolean, base boolean, edges array<struct<ax:double,ay:double,bx:double,by:double,start:boolean>>"


def unit_size(tile: float) -> float:
    """The power of two nearest to ``tile``: cell borders are then exact numbers."""
    return 2.0 ** round(math.log2(tile))


def size_of(level: int, unit: float) -> float:
    return unit * float(SPLIT) ** level


class _Edges:
    def __init__(self, ax, ay, bx, by) -> None:
        self.ax, self.ay, self.bx, self.by = ax, ay, bx, by
        self.low, self.high = np.minimum(ay, by), np.maximum(ay, by)

    def take(self, rows: np.ndarray) -> _Edges:
        return _Edges(self.ax[rows], self.ay[rows], self.bx[rows], self.by[rows])

    def at(self, lat: float) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.ax + ((lat - self.ay) * (self.bx - self.ax)) / (self.by - self.ay)

    def start(self, right: float, bottom: float) -> tuple[np.ndarray, np.ndarray]:
        """(beyond the right side at the start, whether that matters)."""
        first = np.where(self.by >= self.ay, self.ax, self.bx)
        return np.where(self.low <= bottom, self.at(bottom) > right, first > right), self.high > bottom

    def inside(self, lon: float, lat: float, right: float, base: bool, bottom: float) -> bool:
        """Whether a point of a cell is in the polygon. ``right`` is the cell's right side, ``base`` whether that side's lower end (``bottom``) is inside."""
        spans, at = (self.low <= lat) & (self.high > lat), self.at(lat)
        start, matters = self.start(right, bottom)
        beyond = np.where(spans, at > right, np.where(self.by >= self.ay, self.bx, self.ax) > right)
        passed = matters & (self.low <= lat) & (beyond != start)
        return bool(base) != bool(((spans & (lon < at) & (at <= right)) != passed).sum() % 2)

    def even_odd(self, lon: float, lat: float) -> bool:
        return bool((((self.ay > lat) != (self.by > lat)) & (lon < self.at(lat))).sum() % 2)

    def touching(self, x0: float, y0: float, size: float) -> np.ndarray:
        """Edges that meet the closed cell, with a little more around it."""
        slack = 1e-7 * size
        x0, y0, x1, y1 = x0 - slack, y0 - slack, x0 + size + slack, y0 + size + slack
        rows = np.flatnonzero((self.low <= y1) & (self.high >= y0) & (np.minimum(self.ax, self.bx) <= x1) & (np.maximum(self.ax, self.bx) >= x0))
        ax, ay, dx, dy = self.ax[rows], self.ay[rows], (self.bx - self.ax)[rows], (self.by - self.ay)[rows]
        side = [dx * (y - ay) - dy * (x - ax) for x in (x0, x1) for y in (y0, y1)]
        apart = (np.minimum.reduce(side) > 0) | (np.maximum.reduce(side) < 0)
        return rows[~apart]


def cells_of(rings: list[np.ndarray], unit: float, most: int = EDGES, deepest: int = DEEPEST, margin: float = 0.0) -> Iterator[tuple]:
    """(level, cx, cy, inner, base, edges) of one polygon, edges as (ax, ay, bx, by, start).

    With ``margin`` each cell tells about the points in it and up to so far around it: ``inner``, ``base`` and edges are those of the widened cell.
    """
    rings = [r for r in rings if len(r)]
    if not rings:
        return
    after, before = np.concatenate(rings), np.concatenate([np.roll(r, 1, axis=0) for r in rings])
    whole = _Edges(before[:, 0], before[:, 1], after[:, 0], after[:, 1])
    low, high = after.min(axis=0), after.max(axis=0)
    level = 0
    while (high - low).max() > SPLIT * size_of(level, unit):
        level += 1
    size = size_of(level, unit)
    x, y = np.floor((low - margin) / size).astype(int), np.floor((high + margin) / size).astype(int)
    waiting = []
    for cy in range(x[1], y[1] + 1):
        for cx in range(x[0], y[0] + 1):
            some = whole.take(whole.touching(cx * size - margin, cy * size - margin, size + 2 * margin))
            waiting.append((level, cx, cy, whole.even_odd((cx + 1) * size + margin, cy * size - margin), some))
    while waiting:
        level, cx, cy, base, some = waiting.pop()
        size = size_of(level, unit)
        right, bottom = (cx + 1) * size + margin, cy * size - margin
        if not len(some.ax):
            if base:
                yield level, cx, cy, True, True, []
        elif len(some.ax) <= most or level <= deepest:
            start, matters = some.start(right, bottom)
            told = [bool(s) if m else None for s, m in zip(start, matters, strict=True)]
            yield level, cx, cy, False, base, list(zip(some.ax.tolist(), some.ay.tolist(), some.bx.tolist(), some.by.tolist(), told, strict=True))
        else:
            small = size_of(level - 1, unit)
            for ny in range(cy * SPLIT, (cy + 1) * SPLIT):
                for nx in range(cx * SPLIT, (cx + 1) * SPLIT):
                    own = some.take(some.touching(nx * small - margin, ny * small - margin, small + 2 * margin))
                    waiting.append((level - 1, nx, ny, some.inside((nx + 1) * small + margin, ny * small - margin, right, base, bottom), own))


def _area(ring: np.ndarray) -> float:
    x, y = (ring - ring[0]).T
    return float((np.roll(x, 1) * y - x * np.roll(y, 1)).sum() / 2)


def _turned(rings: list[np.ndarray]) -> list[np.ndarray]:
    """Parts counterclockwise and holes clockwise: a ring within an odd number of others is a hole."""
    boxes = np.array([[*r.min(axis=0), *r.max(axis=0)] for r in rings])
    out = []
    for k, ring in enumerate(rings):
        around = (boxes[:, 0] <= boxes[k, 0]) & (boxes[:, 1] <= boxes[k, 1]) & (boxes[:, 2] >= boxes[k, 2]) & (boxes[:, 3] >= boxes[k, 3])
        depth = 0
        for j in np.flatnonzero(around):
            if j != k:
                a, b = np.roll(rings[j], 1, axis=0), rings[j]
                depth += _Edges(a[:, 0], a[:, 1], b[:, 0], b[:, 1]).even_odd(*ring[0])
        out.append(ring if (_area(ring) > 0) == (depth % 2 == 0) else ring[::-1])
    return out


def pieces_of(rings: list[np.ndarray], unit: float, most: int = EDGES, deepest: int = 0, margin: float = 0.0) -> Iterator[tuple[int, int, int, list[np.ndarray]]]:
    """(level, cx, cy, rings) of one polygon: its rings clipped to cells no smaller than needed for few edges.

    With ``margin`` the rings are clipped to cells widened by so much, so that they hold all of the polygon around any point of the cell.
    """
    rings = [r for r in rings if len(r) > 2]
    if not rings:
        return
    every = np.concatenate(rings)
    low, high = every.min(axis=0), every.max(axis=0)
    level = 0
    while (high - low).max() > SPLIT * size_of(level, unit):
        level += 1

    def within(some: list[np.ndarray], n: int, x: range, y: range) -> Iterator[tuple[int, int, int, list[np.ndarray]]]:
        """All cells at once: copies of the rings for every row of cells, then for every column."""
        size, flat = size_of(n, unit), np.concatenate(some)
        u, v, start = flat[:, 0], flat[:, 1], np.concatenate([[0], np.cumsum([len(r) for r in some])])
        for at in (y, x):  # the second axis first
            at, rings = np.asarray(at, float), len(start) - 1
            start = np.concatenate([[0], np.cumsum(np.tile(np.diff(start), len(at)))])
            v, u = np.tile(v, len(at)), np.tile(u, len(at))
            v, u, start = _cut_side(v, u, start, np.repeat(at * size - margin, rings), False)
            u, v, start = _cut_side(v, u, start, np.repeat((at + 1) * size + margin, rings), True)
        # both axes have changed places twice
        v, u = u, v
        use = (np.diff(start) > 2) & (_areas(v, u, start) != 0)
        for k, cell in enumerate(use.reshape(-1, len(some))):
            if cell.any():
                own = [np.stack([v[start[r] : start[r + 1]], u[start[r] : start[r + 1]]], axis=1) for r in k * len(some) + np.flatnonzero(cell)]
                yield n, x[k // len(y)], y[k % len(y)], own

    size = size_of(level, unit)
    a, b = np.floor((low - margin) / size).astype(int), np.floor((high + margin) / size).astype(int)
    waiting = list(within(_turned(rings), level, range(a[0], b[0] + 1), range(a[1], b[1] + 1)))
    while waiting:
        n, cx, cy, own = waiting.pop()
        if n <= deepest or sum(map(len, own)) <= most:
            yield n, cx, cy, own
        else:
            waiting += within(own, n - 1, range(cx * SPLIT, (cx + 1) * SPLIT), range(cy * SPLIT, (cy + 1) * SPLIT))


def _cut_side(u: np.ndarray, v: np.ndarray, start: np.ndarray, bound: np.ndarray, below: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts of rings on one side of a line each: ring k has the vertices from ``start[k]`` on, of which ``u`` is to be at most or at least ``bound[k]``."""
    sizes = np.diff(start)
    b = np.repeat(bound, sizes)
    is_ = u <= b if below else u >= b
    before = np.arange(len(u)) - 1
    some = sizes > 0
    before[start[:-1][some]] = start[1:][some] - 1
    crossed = is_[before] != is_
    end = np.cumsum(crossed.astype(np.int64) + is_)
    out_u, out_v = np.empty((2, int(end[-1]) if len(end) else 0))
    at = end[is_] - 1
    out_u[at], out_v[at] = u[is_], v[is_]
    at, i = (end - is_)[crossed] - 1, np.flatnonzero(crossed)
    j = before[i]
    out_u[at], out_v[at] = b[i], v[j] + (b[i] - u[j]) * (v[i] - v[j]) / (u[i] - u[j])
    return out_u, out_v, np.concatenate([[0], end])[start]


def _areas(x: np.ndarray, y: np.ndarray, start: np.ndarray) -> np.ndarray:
    """``_area`` of many rings."""
    sizes = np.diff(start)
    some = sizes > 0
    first, before = np.repeat(start[:-1], sizes), np.arange(len(x)) - 1
    before[start[:-1][some]] = start[1:][some] - 1
    dx, dy = x - x[first], y - y[first]
    area = np.zeros(len(sizes))
    if len(x):
        area[some] = np.add.reduceat((dx[before] * dy - dx * dy[before]) / 2, start[:-1][some])
    return area


def cut_by_squares(x: np.ndarray, y: np.ndarray, start: np.ndarray, lon: np.ndarray, lat: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rings (ring k from ``start[k]`` on) cut by the squares around ``lon[k]``, ``lat[k]``: the same, and their areas, positive if counterclockwise."""
    for bound, below in ((lon - half, False), (lon + half, True)):
        x, y, start = _cut_side(x, y, start, bound, below)
    for bound, below in ((lat - half, False), (lat + half, True)):
        y, x, start = _cut_side(y, x, start, bound, below)
    return x, y, start, _areas(x, y, start)


def areas_in_squares(lon: np.ndarray, lat: np.ndarray, half: float, xy: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The area of rings (``xy`` flat, ``sizes`` vertices each) within each of the squares around places in the order of ``lat``.

    The sum over the edges of the integral, along latitude, of the distance to the square's left side.
    """
    out, wide = np.zeros(len(lon)), 2 * half
    after = np.reshape(xy, (-1, 2))
    end = np.cumsum(sizes)
    before = np.roll(after, 1, axis=0)
    before[end - sizes] = after[end - 1]
    low, high = np.minimum(before[:, 1], after[:, 1]), np.maximum(before[:, 1], after[:, 1])
    rows = np.searchsorted(lat, low - half, "right"), np.searchsorted(lat, high + half, "left")
    left, bottom, top = lon - half, lat - half, lat + half
    for (ax, ay), (bx, by), lo, hi, i, j in zip(before.tolist(), after.tolist(), low.tolist(), high.tolist(), rows[0].tolist(), rows[1].tolist(), strict=True):
        if hi <= lo or j <= i:
            continue
        from_, to = np.maximum(bottom[i:j], lo), np.minimum(top[i:j], hi)
        slope = (bx - ax) / (by - ay)
        u, v = ax + (from_ - ay) * slope - left[i:j], ax + (to - ay) * slope - left[i:j]
        p, q = np.minimum(u, v), np.maximum(u, v)
        inner_p, inner_q = np.clip(p, 0.0, wide), np.clip(q, 0.0, wide)
        run = q - p
        # where the edge is upright, its own distance
        mean = ((inner_q - inner_p) * (inner_q + inner_p) / 2 + wide * (np.maximum(q, wide) - np.maximum(p, wide))) / np.where(run > 0, run, 1.0)
        part = np.maximum(to - from_, 0.0) * np.where(run > 0, mean, inner_p)
        out[i:j] += part if by > ay else -part
    return out


_PIECES = "level int, cx long, cy long, lon0 double, lon1 double, lat0 double, lat1 double, xy array<double>, sizes array<int>"


def _per_polygon(polys: DataFrame, ring: str, schema: str, rows_of) -> DataFrame:
    """The polygons' columns without ``ring`` beside each row that ``rows_of`` makes of their rings."""
    kind = polys.schema[ring].dataType
    many = isinstance(kind.elementType, ArrayType)
    keep = [c for c in polys.columns if c != ring]
    # Rings travel as plain arrays of numbers.
    parts = F.col(ring) if many else F.array(F.col(ring))
    flat = F.transform(F.filter(parts, lambda r: r.isNotNull()), lambda r: F.flatten(F.transform(r, lambda v: F.array(v["lon"], v["lat"]))))
    narrow = polys.where(F.col(ring).isNotNull()).select(F.struct(*keep, F.lit(0).alias("_none")).alias("_row"), flat.alias("_rings"))
    # A polygon is little in bytes and much in work.
    narrow = narrow.repartition(int(polys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in polys.schema if f.name != ring)
    names = [*keep, *[f.split(" ", 1)[0] for f in schema.split(", ")]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row, rings in zip(frame["_row"], frame["_rings"], strict=True):
                own = tuple(row[c] for c in keep)
                for made in rows_of([np.asarray(r, float).reshape(-1, 2) for r in rings]):
                    rows.append((*own, *made))
                    if len(rows) == 5000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            yield pd.DataFrame(rows, columns=names)

    return narrow.mapInPandas(run, fields + schema)


def cover(polys: DataFrame, ring: str = "ring", unit: float = 1.0, most: int = EDGES, deepest: int = DEEPEST, margin: float = 0.0) -> DataFrame:
    """One row per cell of each polygon: its columns without ``ring``, then level, cx, cy, inner, base, edges (see ``cells_of``)."""

    def rows_of(rings: list[np.ndarray]) -> Iterator[tuple]:
        for *cell, edges in cells_of(rings, unit, most, deepest, margin):
            yield *cell, [dict(zip(("ax", "ay", "bx", "by", "start"), e, strict=True)) for e in edges]

    return _per_polygon(polys, ring, _CELL, rows_of)


def clipped(polys: DataFrame, ring: str = "ring", unit: float = 1.0, most: int = EDGES, deepest: int = 0, margin: float = 0.0) -> DataFrame:
    """One row per cell that a polygon fills at least partly: its columns without ``ring``, then level, cx, cy, the box of its rings in the cell
    and the rings, holes clockwise: vertices in ``xy`` one after the other, ``sizes`` of them in each ring (see ``pieces_of``)."""

    def rows_of(rings: list[np.ndarray]) -> Iterator[tuple]:
        for *cell, own in pieces_of(rings, unit, most, deepest, margin):
            xy = np.concatenate(own)
            (lon0, lat0), (lon1, lat1) = xy.min(axis=0).tolist(), xy.max(axis=0).tolist()
            yield *cell, lon0, lon1, lat0, lat1, xy.ravel(), [len(r) for r in own]

    return _per_polygon(polys, ring, _PIECES, rows_of)
