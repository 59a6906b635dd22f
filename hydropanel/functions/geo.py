"""Map projection and point-in-ring test as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from hydropanel.functions.calendar import as_col

# North America Albers equal-area conic on the GRS80 ellipsoid.
AXIS = 6378137.0
FLATTENING = 1 / 298.257222101
PARALLELS = (20.0, 60.0)
ORIGIN = (-96.0, 40.0)  # lon, lat

_E2 = FLATTENING * (2 - FLATTENING)
_E = math.sqrt(_E2)


def _authalic(s: float) -> float:
    """Snyder's q for a sine of latitude."""
    return (1 - _E2) * (s / (1 - _E2 * s * s) - math.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))


def _cone() -> tuple[float, float, float, float]:
    """Cone constant n, C, rho0 and the polar q."""
    m2 = []
    q = []
    for lat in PARALLELS:
        s = math.sin(math.radians(lat))
        m2.append((1 - s * s) / (1 - _E2 * s * s))
        q.append(_authalic(s))
    n = (m2[0] - m2[1]) / (q[1] - q[0])
    c = m2[0] + n * q[0]
    rho0 = AXIS * math.sqrt(c - n * _authalic(math.sin(math.radians(ORIGIN[1])))) / n
    return n, c, rho0, _authalic(1.0)


CONE = _cone()


def to_albers(lon, lat) -> tuple[Column, Column]:
    """Degrees to metres."""
    n, c, rho0, _ = CONE
    s = F.sin(F.radians(as_col(lat)))
    q = (1 - _E2) * (s / (1 - _E2 * s * s) - F.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))
    rho = AXIS * F.sqrt(c - n * q) / n
    theta = n * F.radians(as_col(lon) - ORIGIN[0])
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def from_albers(x, y) -> tuple[Column, Column]:
    """Metres to degrees (series for the latitude, good to about 1e-8 degrees)."""
    n, c, rho0, qp = CONE
    x, y = as_col(x), as_col(y)
    rho2 = x * x + (rho0 - y) * (rho0 - y)
    theta = F.atan2(x, rho0 - y)
    q = (c - rho2 * n * n / (AXIS * AXIS)) / n
    beta = F.asin(q / qp)
    a2 = _E2 / 3 + 31 * _E2**2 / 180 + 517 * _E2**3 / 5040
    a4 = 23 * _E2**2 / 360 + 251 * _E2**3 / 3780
    a6 = 761 * _E2**3 / 45360
    phi = beta + a2 * F.sin(2 * beta) + a4 * F.sin(4 * beta) + a6 * F.sin(6 * beta)
    return ORIGIN[0] + F.degrees(theta / n), F.degrees(phi)


def in_ring(lon, lat, ring) -> Column:
    """Even-odd rule over a ring ``array<struct<lon,lat>>`` (open or closed).

    Half-open in latitude, so a vertex is counted once.
    """
    lon, lat, ring = as_col(lon), as_col(lat), as_col(ring)
    # every vertex beside the one before it; the first pairs with the last
    previous = F.concat(F.slice(ring, -1, 1), F.slice(ring, 1, F.size(ring) - 1))
    edges = F.arrays_zip(ring.alias("b"), previous.alias("a"))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        at = a["lon"] + F.try_divide((lat - a["lat"]) * (b["lon"] - a["lon"]), b["lat"] - a["lat"])
        return spans & (lon < at)

    return F.size(F.filter(edges, crosses)) % 2 == 1


def in_polygon(lon, lat, rings) -> Column:
    """The same over all rings of a polygon: parts add, holes take away."""
    lon, lat = as_col(lon), as_col(lat)
    return F.size(F.filter(as_col(rings), lambda ring: in_ring(lon, lat, ring))) % 2 == 1


def ring_area(ring) -> Column:
    """Area within a ring, positive if it turns counterclockwise."""
    ring = as_col(ring)
    x, y = F.get(ring, 0)["lon"], F.get(ring, 0)["lat"]
    last = F.get(ring, F.size(ring) - 1)

    # The vertex before goes along with the total: lists of pairs would cost more than the sums.
    def step(total, lon, lat) -> Column:
        return F.struct(total.alias("total"), lon.alias("lon"), lat.alias("lat"))

    def add(so_far: Column, b: Column) -> Column:
        return step(so_far["total"] + ((so_far["lon"] - x) * (b["lat"] - y) - (b["lon"] - x) * (so_far["lat"] - y)) / 2, b["lon"], b["lat"])

    return F.aggregate(ring, step(F.lit(0.0), last["lon"], last["lat"]), add, lambda so_far: so_far["total"])
