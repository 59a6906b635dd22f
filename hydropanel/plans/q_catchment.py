"""Daily series of single catchments."""

from pyspark.sql import functions as F

from hydropanel.operators import catchment
from hydropanel.plans.registry import query

AREA = 3_962_682.0
KEYS = ["site_number"]
_WY = "CAST(year(date) + CASE WHEN month(date) > {} THEN 1 ELSE 0 END AS INTEGER)"
_SEASON = "CASE WHEN month(date) IN (12,1,2) THEN 'DJF' WHEN month(date) IN (3,4,5) THEN 'MAM' WHEN month(date) IN (6,7,8) THEN 'JJA' ELSE 'SON' END"


@query(
    "ct_season_re",
    f"""SELECT *, CASE WHEN abs(ratio) < 9999 THEN ratio END AS season_re FROM (
      SELECT *, season_q * (86400 * 90) / {AREA!r}::DOUBLE / nullif(season_precip, 0) AS ratio FROM (
      SELECT site_number, {_SEASON} AS season, {_WY.format(8)} AS water_year, avg(mean_q) AS season_q, sum(precip_m) AS season_precip
      FROM daily GROUP BY 1, 2, 3))""".replace("SELECT *, CASE", "SELECT * EXCLUDE (ratio), CASE"),
    "season_q season_precip season_re",
)
def ct_season_re(p):
    return catchment.season_re(p.daily, KEYS, F.lit(AREA))


def _block(name: str) -> str:
    months, seconds = catchment.BLOCKS[name]
    return f"""SELECT *, {name}_flow * {seconds}::DOUBLE / {AREA!r}::DOUBLE / nullif({name}_precip, 0) AS {name}_re FROM (
      SELECT site_number, {_WY.format(9)} AS water_year, sum(precip_m) AS {name}_precip, avg(mean_q) AS {name}_flow, avg(well_m) AS {name}_well
      FROM daily WHERE month(date) IN ({', '.join(map(str, months))}) GROUP BY 1, 2)"""


def _build(p, name: str):
    months, seconds = catchment.BLOCKS[name]
    return catchment.season_block(p.staged.get("daily", p.daily), KEYS, F.lit(AREA), months, seconds, name)


@query("ct_season_block", _block("september"), "september_precip september_flow september_well september_re")
def ct_season_block(p):
    return _build(p, "september")


_FOUR = ["winter", "spring", "summer", "fall"]
_WIDE = [f"{n}_{v}" for n in _FOUR for v in ("precip", "flow", "well", "re")]


@query(
    "ct_season_wide",
    f"SELECT *, summer_re / nullif(winter_re, 0) AS norm_re FROM ({_block('winter')}) "
    + " ".join(f"JOIN ({_block(n)}) USING (site_number, water_year)" for n in _FOUR[1:]),
    [*_WIDE, "norm_re"],
)
def ct_season_wide(p):
    """The four blocks from one pass; years without one of them are left out, as a join of the blocks would."""
    wide = catchment.season_blocks(p.daily, KEYS, F.lit(AREA))
    wide = wide.na.drop(subset=[f"{n}_flow" for n in _FOUR])
    return catchment.season_wide([wide], KEYS)


@query(
    "ct_season_wide_join",
    f"SELECT *, summer_re / nullif(winter_re, 0) AS norm_re FROM ({_block('winter')}) JOIN ({_block('summer')}) USING (site_number, water_year)",
    [*(c for c in _WIDE if c.startswith(("winter", "summer"))), "norm_re"],
)
def ct_season_wide_join(p):
    """Two blocks built by themselves from written daily values, then joined."""
    p.stage("daily")
    return catchment.season_wide([_build(p, "winter"), _build(p, "summer")], KEYS)


@query(
    "ct_cold_months",
    f"""SELECT *, month_flow * 2628000 / {AREA!r}::DOUBLE / nullif(precip_sum, 0) AS re FROM (
      SELECT site_number, CAST(month(date) AS INTEGER) AS month, {_WY.format(9)} AS water_year, avg(temp_c) AS month_temp,
      avg(well_m) AS month_well, sum(precip_m) AS precip_sum, avg(mean_q) AS month_flow FROM daily GROUP BY 1, 2, 3
      HAVING avg(temp_c) <= 0)""",
    "month_temp month_well precip_sum month_flow re",
)
def ct_cold_months(p):
    return catchment.cold_months(p.daily, KEYS, F.lit(AREA))


@query(
    "ct_dual_axis_long",
    """SELECT site_number, water_year, unnest(['fall', 'winter', 'summer']) AS variable, 5 - unnest([fall_well, winter_well, summer_well]) AS value,
      unnest([2, 1, 3]) AS "order" FROM ("""
    + f"SELECT site_number, {_WY.format(9)} AS water_year, "
    + ", ".join(
        f"avg(well_m) FILTER (month(date) IN ({', '.join(map(str, catchment.BLOCKS[n][0]))})) AS {n}_well"
        for n in ("fall", "winter", "summer")
    )
    + " FROM daily GROUP BY 1, 2)",
    "value",
)
def ct_dual_axis_long(p):
    wells = catchment.season_blocks(p.daily, KEYS, F.lit(AREA), ("fall", "winter", "summer"))
    wells = wells.select("site_number", "water_year", *[F.col(f"{n}_well").alias(n) for n in ("fall", "winter", "summer")])
    return catchment.groundwater_long(wells, ["site_number", "water_year"], {"winter": 1, "fall": 2, "summer": 3})
