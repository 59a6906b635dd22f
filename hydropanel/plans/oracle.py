"""The same domain tables as SQL, for the check of the registered queries."""

from __future__ import annotations

import math
import re

from hydropanel.functions import geo
from hydropanel.plans.panels import BASIN_OFFSETS, RING_OFFSETS

N, C, RHO0, QP = (repr(v) for v in geo.CONE)
_E2, _E = repr(geo._E2), repr(math.sqrt(geo._E2))
_S = "sin(radians(lat))"
_Q = f"((1 - {_E2}) * ({_S} / (1 - {_E2} * {_S} * {_S}) - ln((1 - {_E} * {_S}) / (1 + {_E} * {_S})) / (2 * {_E})))"
ALBERS_X = f"({geo.AXIS!r} * sqrt({C} - {N} * {_Q}) / {N}) * sin({N} * radians(lon + 96.0))"
ALBERS_Y = f"{RHO0} - ({geo.AXIS!r} * sqrt({C} - {N} * {_Q}) / {N}) * cos({N} * radians(lon + 96.0))"

SEASON = (
    "CASE WHEN month IN (12,1,2) THEN 'DJF' WHEN month IN (3,4,5) THEN 'MAM' "
    "WHEN month IN (6,7,8) THEN 'JJA' ELSE 'SON' END"
)
WYEAR = "CAST(year(date) + CASE WHEN month(date) > 9 THEN 1 ELSE 0 END AS INTEGER)"
DAYS = "CASE WHEN month = 2 THEN 28 WHEN month IN (4,6,9,11) THEN 30 ELSE 31 END"


def z(col: str, part: str) -> str:
    """Standard score by group; NULL for constant groups."""
    return f"({col} - avg({col}) OVER ({part})) / nullif(stddev_samp({col}) OVER ({part}), 0)"


def _scores(source: str, time: str) -> str:
    w = "PARTITION BY site_number"
    return f"""SELECT site_number, cluster, {time}, mean_q, precip_m, temp_k, runoff_ratio, off_precip, off_temp,
      log10(runoff_ratio) AS log_runoff,
      {z('log10(mean_q)', w)} AS z_q, {z('log10(runoff_ratio)', w)} AS z_log_runoff, {z('runoff_ratio', w)} AS z_runoff,
      {z('log10(precip_m)', w)} AS z_precip, {z('log10(off_precip)', w)} AS z_off_precip,
      {z('log10(temp_k)', w)} AS z_temp, {z('log10(off_temp)', w)} AS z_off_temp FROM {source}"""


def _offset(panel: str, time: str) -> str:
    return f"""SELECT a.site_number, a.cluster, a.{time}, a.mean_q, a.precip_m, a.temp_k, a.runoff_ratio,
      b.precip_m AS off_precip, b.temp_k AS off_temp
      FROM {panel} a JOIN {panel} b ON a.site_number = b.site_number AND a.{time} = b.{time} + 1
      WHERE a.mean_q > 0 AND b.mean_q > 0"""


def _region(source: str, keys: str, cols) -> str:
    return f"SELECT {keys}, " + ", ".join(f"avg({c}) AS {c}" for c in cols) + f" FROM {source} GROUP BY {keys}"


_Z = ["z_q", "z_log_runoff", "z_runoff", "z_precip", "z_off_precip", "z_temp", "z_off_temp"]
_ZS = ["season_q", "season_runoff", "fall_precip", "winter_precip", "spring_precip", "summer_precip", "prior_summer_precip"]


def _total(season: str, anchor: int, name: str) -> str:
    return (
        f"CASE WHEN count(*) FILTER (month = {anchor}) > 0 THEN "
        f"log10(sum(precip_m) FILTER (season = '{season}')) END AS {name}"
    )


def _edges(rings) -> str:
    values = ", ".join(
        f"({a[0]!r}::DOUBLE, {a[1]!r}::DOUBLE, {b[0]!r}::DOUBLE, {b[1]!r}::DOUBLE)"
        for ring in rings
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True)
    )
    return f"""SELECT site_number AS identifier, lon + ax AS x1, lat + ay AS y1, lon + bx AS x2, lat + b_y AS y2
      FROM site, (VALUES {values}) v(ax, ay, bx, b_y)"""


def _ring_edges(rings) -> str:
    """The same with the ring's number and the site's own place."""
    values = ", ".join(
        f"({r}, {a[0]!r}::DOUBLE, {a[1]!r}::DOUBLE, {b[0]!r}::DOUBLE, {b[1]!r}::DOUBLE)"
        for r, ring in enumerate(rings)
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True)
    )
    return f"""SELECT site_number AS identifier, r, lon AS mx, lat AS my, lon + ax AS x1, lat + ay AS y1, lon + bx AS x2, lat + b_y AS y2
      FROM site, (VALUES {values}) v(r, ax, ay, bx, b_y)"""


def _inside(edges: str) -> str:
    return f"""SELECT point_id, identifier FROM points, {edges}
      WHERE (y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1)
      GROUP BY point_id, identifier HAVING count(*) % 2 = 1"""


CTES = {
    "site": """SELECT CAST(s_suppkey AS VARCHAR) AS site_number, n_regionkey AS cluster,
      (1000 + abs(s_acctbal)) * 1000000 AS area,
      CAST(-142.0 AS DOUBLE) + (s_suppkey * 7919 % 9200) / 100 AS lon,
      CAST(24.5 AS DOUBLE) + (s_suppkey * 104729 % 4550) / 100 AS lat, s_acctbal / 10 AS elev
      FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "obs": """SELECT CAST(l_suppkey AS VARCHAR) AS site_number, CAST(l_shipdate AS DATE) AS date,
      l_extendedprice AS q_cfs, l_quantity AS precip, l_discount AS discount, l_tax AS tax FROM lineitem""",
    "daily": """SELECT site_number, date, avg(q_cfs) * CAST(0.028316846592 AS DOUBLE) AS mean_q,
      max(q_cfs) * CAST(0.028316846592 AS DOUBLE) AS peak_q, sum(precip) / CAST(39.37 AS DOUBLE) AS precip_m,
      (1 + 100 * avg(tax)) / CAST(3.281 AS DOUBLE) AS well_m, 100 * avg(discount) - CAST(5.0037 AS DOUBLE) AS temp_c
      FROM obs GROUP BY site_number, date""",
    "panel_year": f"""SELECT *, mean_q * 31536000 / area / nullif(precip_m, 0) AS runoff_ratio FROM (
      SELECT site_number, {WYEAR} AS year, avg(q_cfs) * CAST(0.028316846592 AS DOUBLE) AS mean_q,
      sum(precip) / CAST(39.37 AS DOUBLE) AS precip_m, CAST(273.15 AS DOUBLE) + 100 * avg(discount) AS temp_k
      FROM obs GROUP BY ALL) JOIN (SELECT site_number, cluster, area, lon, lat FROM site) USING (site_number)""",
    "panel_month": f"""SELECT *, CAST(cal_year + CASE WHEN month > 9 THEN 1 ELSE 0 END AS INTEGER) AS year, {SEASON} AS season,
      cal_year * 12 + month AS t, mean_q * CAST(2628002.88 AS DOUBLE) / area / nullif(precip_m, 0) AS runoff_ratio FROM (
      SELECT site_number, CAST(year(date) AS INTEGER) AS cal_year, CAST(month(date) AS INTEGER) AS month,
      avg(q_cfs) * CAST(0.028316846592 AS DOUBLE) AS mean_q,
      sum(precip) / CAST(39.37 AS DOUBLE) AS precip_m, CAST(273.15 AS DOUBLE) + 100 * avg(discount) AS temp_k
      FROM obs GROUP BY ALL) JOIN (SELECT site_number, cluster, area, lon, lat FROM site) USING (site_number)""",
    "offset_year": _offset("panel_year", "year"),
    "offset_month": _offset("panel_month", "t"),
    "z_year": _scores("offset_year", "year"),
    "z_month": _scores("offset_month", "t"),
    "region_year": _region("z_year", "cluster, year", _Z),
    "region_month": _region("z_month", "cluster, t", _Z),
    "season_months": """SELECT *, runoff_ratio AS r, CASE WHEN season = 'SON' THEN cal_year ELSE year END AS sy
      FROM panel_month WHERE precip_m > 0 AND mean_q > 0""",
    "season_means": """SELECT site_number, season, sy, log10(avg(r)) AS season_runoff, log10(avg(mean_q)) AS season_q,
      log10(avg(temp_k)) AS season_temp FROM season_months GROUP BY site_number, season, sy""",
    "season_precips": f"""SELECT * FROM (SELECT site_number,
      CASE WHEN season = 'SON' THEN cal_year + 1 ELSE year END AS year,
      {_total('SON', 10, 'fall_precip')}, {_total('DJF', 1, 'winter_precip')},
      {_total('MAM', 4, 'spring_precip')}, {_total('JJA', 7, 'summer_precip')}
      FROM season_months GROUP BY 1, 2) WHERE fall_precip IS NOT NULL AND winter_precip IS NOT NULL
      AND spring_precip IS NOT NULL AND summer_precip IS NOT NULL""",
    "season_rows": """SELECT m.site_number, m.cluster, m.year, m.cal_year, m.season, m.month, s.season_q, s.season_runoff, s.season_temp,
      CASE m.season WHEN 'SON' THEN fall_precip WHEN 'DJF' THEN winter_precip WHEN 'MAM' THEN spring_precip ELSE summer_precip END
        AS season_precip, fall_precip, winter_precip, spring_precip, summer_precip
      FROM season_months m JOIN season_means s USING (site_number, season, sy)
      JOIN season_precips p ON p.site_number = m.site_number AND p.year = m.year""",
    "season_values": """SELECT a.*, b.fall_precip AS prior_fall_precip, b.winter_precip AS prior_winter_precip,
      b.spring_precip AS prior_spring_precip, b.summer_precip AS prior_summer_precip
      FROM season_rows a JOIN season_rows b ON a.site_number = b.site_number AND a.month = b.month AND a.year = b.year + 1
      QUALIFY row_number() OVER (PARTITION BY a.site_number, a.year, a.season ORDER BY a.month) = 1""",
    "z_season": "SELECT *, "
    + ", ".join(f"{z(c, 'PARTITION BY site_number, season')} AS z_{c}" for c in _ZS)
    + " FROM season_values",
    "region_season": _region(
        "(SELECT *, CASE WHEN season = 'SON' THEN cal_year ELSE year END AS season_year FROM z_season)",
        "cluster, season, season_year",
        [f"z_{c}" for c in _ZS],
    ),
    "points": f"""SELECT *, {ALBERS_X} AS x, {ALBERS_Y} AS y FROM (SELECT c_custkey AS point_id,
      CAST(-142.0 AS DOUBLE) + (c_custkey * 7919 % 9200) / 100 AS lon,
      CAST(24.5 AS DOUBLE) + (c_custkey * 104729 % 4550) / 100 AS lat, c_acctbal AS value FROM customer)""",
    "cells": """SELECT point_id AS cell_id, lon, lat, time, v AS value FROM (
      SELECT o_custkey AS point_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS time, avg(o_totalprice) * CAST(0.028316846592 AS DOUBLE) AS v
      FROM orders GROUP BY 1, 2) JOIN points USING (point_id)""",
    "edges": _edges([RING_OFFSETS]),
    "basin_edges": _edges(BASIN_OFFSETS),
    "ring_edges": _ring_edges(BASIN_OFFSETS),
    "inside": _inside("edges"),
    "inside_basin": _inside("basin_edges"),
    "vectors": "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label AS cluster FROM embeddings",
}


def sql(body: str, doubles=(), more: dict[str, str] | None = None, digits: int = 6) -> str:
    """Body with the tables it names, and its real columns rounded."""
    tables = CTES | (more or {})
    needed: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in tables:
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                visit(tables[name])
                needed.append(name)

    visit(body)
    head = "WITH " + ", ".join(f"{n} AS ({tables[n]})" for n in needed) + " " if needed else ""
    if doubles:
        swap = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in doubles)
        return f"{head}SELECT * REPLACE ({swap}) FROM ({body}) AS result"
    return head + body
