"""Sums of cell values over polygons without a row for each pair of a cell and a polygon.

Such pairs grow with the square of the input (cells times polygons that overlap them). Here the rows of a place and the pieces of all polygons around it (see
``cover``) meet in one task, which tests the places and adds up the values on the spot; what leaves it is one row for
each polygon and key. A crowded place is cut into slices of rows and of polygons, so a task's memory is bounded. All pairs
are still tested, in the tasks only: time grows with their number, rows sent do not.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydropanel.operators.cover import DEEPEST, areas_in_squares, clipped, cover, size_of, unit_size
from hydropanel.operators.pairs import cogroup_spread
from hydropanel.sources import checkpoint_table

# Rows of values, edges and sums of a task at most, about; polygons and keys that are summed at once.
ROWS, EDGE_ROWS, SUMS = 200_000, 500_000, 1_000_000
POLYS, KEYS = 256, 64
# Vertices of a polygon in a cell, about, where shares are areas.
VERTICES = 64


def zone_sums(rows: DataFrame, polys: DataFrame, keys, tile: float = 1.0, steps=(0.0,), square: float | None = None, least: float = 0.0) -> DataFrame:
    """``identifier``, ``keys``, ``_vw``, ``_w`` and ``_n``: partial sums of ``rows`` (lon, lat, keys, _vw, _w, _n) over ``polys`` (identifier, ring, _times).

    A row counts for a polygon by the share of its points (lon and lat plus each of ``steps``) inside, or of the ``square`` around it, times ``_times``; ``_n`` by one if any is inside,
    or with a single point ``_times`` as well. A row may say how often it is ``_listed``, which its sums hold already; shares, times both numbers, count above ``least``.
    """
    keys = list(keys)
    margin = max(map(abs, steps)) if square is None else square / 2
    unit = unit_size(2 * tile)
    while unit < 4 * margin:
        unit *= 2
    finite = F.col("lon").between(-1e300, 1e300) & F.col("lat").between(-1e300, 1e300)
    rows = checkpoint_table(rows.where(finite))  # read for their numbers and for the sums
    if square is None:
        parts = cover(polys, unit=unit, margin=margin, deepest=0 if margin else DEEPEST)
    else:
        parts = clipped(polys, unit=unit, margin=margin, deepest=-1, most=VERTICES).withColumnRenamed("xy", "edges")
    parts = checkpoint_table(parts)
    levels = sorted(r[0] for r in parts.select("level").distinct().collect())  # a handful
    spot = ["level", "cx", "cy"]
    at = [F.struct(F.lit(n).alias("level"), F.floor(F.col("lon") / s).alias("cx"), F.floor(F.col("lat") / s).alias("cy")) for n in levels for s in [size_of(n, unit)]]
    empty = F.expr("cast(array() as array<struct<level:int,cx:bigint,cy:bigint>>)")
    placed = rows.select("*", F.inline(F.concat(empty, *[F.array(a) for a in at])))

    kinds = F.approx_count_distinct(F.xxhash64(*keys)) if keys else F.lit(1)
    n_rows = placed.groupBy(*spot).agg(F.count(F.lit(1)).alias("_rows"), kinds.alias("_kinds"))
    n_polys = parts.groupBy(*spot).agg(F.count(F.lit(1)).alias("_polys"), F.sum(F.size("edges")).alias("_edges"))
    slices = F.ceil(F.col("_rows") / ROWS)
    sums = F.col("_polys") * F.least("_kinds", F.ceil(F.col("_rows") / slices))
    sizes = checkpoint_table(
        n_rows.join(n_polys, spot).select(*spot, slices.cast("int").alias("_a"), F.greatest(F.ceil(sums / SUMS), F.ceil(F.col("_edges") / EDGE_ROWS), F.lit(1)).cast("int").alias("_b"))
    )
    some, every = (lambda n, *c: F.pmod(F.xxhash64(*c), F.col(n)).cast("int")), (lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    left = placed.join(sizes, spot).withColumn("_i", some("_a", "lon", "lat", *keys)).withColumn("_j", every("_b")).drop("_a", "_b")
    flat = F.flatten(F.transform("edges", lambda e: F.array(e["ax"], e["ay"], e["bx"], e["by"], F.coalesce(e["start"].cast("double"), F.lit(-1.0)))))
    flat = flat if square is None else F.col("edges")
    right = parts.join(sizes, spot).withColumn("edges", flat).withColumn("_j", some("_b", "identifier")).withColumn("_i", every("_a")).drop("_a", "_b")

    def solve(key, lpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
        side = (int(key[1]) + 1) * size_of(int(key[0]), unit) + margin
        return _sums(lpdf, rpdf, keys, side, steps, square, least)

    types = {f.name: f.dataType.simpleString() for f in (*rows.schema, *parts.schema)}
    schema = ", ".join(f"`{c}` {types[c]}" for c in ("identifier", *keys)) + ", _vw double, _w double, _n double"
    found = cogroup_spread(left, right, [*spot, "_i", "_j"], solve, schema)
    # No sum is null; a NaN leaves pandas as one.
    return found.withColumns({c: F.coalesce(c, F.lit(float("nan"))) for c in ("_vw", "_w", "_n")})


def _sums(rows: pd.DataFrame, polys: pd.DataFrame, keys: list[str], right: float, steps, square: float | None, least: float) -> pd.DataFrame:
    out = []
    if len(rows) and len(polys):
        by = ["lon", "lat", *(["_listed"] if "_listed" in rows else [])]
        places, place = np.unique(rows[by].to_numpy(float), axis=0, return_inverse=True)
        listed = places[:, 2] if len(by) > 2 else np.ones(len(places))
        alone = len(steps) == 1 and square is None
        place = place.ravel()
        code = rows.groupby(keys, dropna=False, sort=False).ngroup().to_numpy() if keys else np.zeros(len(rows), int)
        kinds = rows[keys].iloc[np.unique(code, return_index=True)[1]]
        weights = rows[["_vw", "_w", "_n"]].to_numpy(float)
        x, y = (np.concatenate([places[:, k] + d[k] for d in ((a, b) for a in steps for b in steps)]) for k in (0, 1))
        order = np.argsort(y, kind="stable")
        x, y, back = x[order], y[order], np.argsort(order, kind="stable")
        chunks = []
        for lo in range(0, len(kinds), KEYS):
            use = np.flatnonzero((code >= lo) & (code < lo + KEYS))
            own, u = np.unique(place[use], return_inverse=True)
            n = min(KEYS, len(kinds) - lo)
            cell = u.ravel() * n + code[use] - lo
            tables = [np.bincount(cell, weights=w, minlength=len(own) * n).reshape(-1, n) for w in (*weights[use].T, np.ones(len(use)))]
            chunks.append((lo, own, tables))
        for start in range(0, len(polys), POLYS):
            few = polys.iloc[start : start + POLYS]
            share = np.empty((len(few), len(places)))
            if square is not None:
                for row, (edges, sizes) in enumerate(zip(few["edges"], few["sizes"], strict=True)):
                    share[row] = areas_in_squares(x, y, square / 2, edges, sizes)[back] / (square * square)
            else:
                for row, (inner, base, edges) in enumerate(zip(few["inner"], few["base"], few["edges"], strict=True)):
                    share[row] = 1.0 if inner else inside(x, y, right, base, np.reshape(edges, (-1, 5)))[back].reshape(-1, len(places)).mean(axis=0)
            times = few["_times"].to_numpy(float)[:, None]
            share *= times
            share[share * listed <= max(least, 1e-12 if square else 0.0)] = 0.0  # what is left of rounding
            once = (share > 0).astype(float) * (times if alone else 1.0)
            for lo, own, (vw, w, n, any_) in chunks:
                present = once[:, own] @ any_
                q, t = np.nonzero(present)
                if not len(q):
                    continue
                counted = present if np.array_equal(n, any_) else _product(once[:, own], n)
                by_share = counted if alone and np.array_equal(w, n) else _product(share[:, own], w)
                total = _product(share[:, own], vw)
                part = pd.DataFrame({"identifier": few["identifier"].to_numpy()[q]})
                for c in keys:
                    part[c] = kinds[c].array.take(lo + t)
                out.append(part.assign(_vw=total[q, t], _w=by_share[q, t], _n=counted[q, t]))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: np.empty(0, object) for c in ("identifier", *keys, "_vw", "_w", "_n")})


def _product(share: np.ndarray, table: np.ndarray) -> np.ndarray:
    """``share @ table`` where a share of zero takes nothing of a value that is not finite."""
    odd = np.argwhere(~np.isfinite(table))
    if not len(odd):
        return share @ table
    out = share @ np.where(np.isfinite(table), table, 0.0)
    for u, t in odd:
        took = share[:, u] > 0
        out[took, t] += share[took, u] * table[u, t]
    return out


def inside(x: np.ndarray, y: np.ndarray, right: float, base: bool, edges: np.ndarray) -> np.ndarray:
    """Whether points of a cell, in the order of y, are in the polygon: ``_Edges.inside`` of ``cover`` for edges (ax, ay, bx, by, start).

    An edge's ``start`` says whether it is beyond the right side at the cell's lower end or at its own lower end, -1 if it ends below.
    """
    odd = np.full(len(x), bool(base))
    ends = np.searchsorted(y, [np.minimum(edges[:, 1], edges[:, 3]), np.maximum(edges[:, 1], edges[:, 3])])
    for (ax, ay, bx, by, start), i, j in zip(edges.tolist(), *ends.tolist(), strict=True):
        if j > i:
            at = ax + ((y[i:j] - ay) * (bx - ax)) / (by - ay)
            beyond = at > right
            odd[i:j] ^= (x[i:j] < at) & ~beyond
            if start >= 0:
                odd[i:j] ^= beyond != bool(start)
        if start >= 0 and ((bx if by >= ay else ax) > right) != bool(start):
            odd[j:] ^= True
    return odd
