"""Monthly flow, the season panel and calendar totals of gridded climate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydropanel.functions import calendar, units
from hydropanel.operators.aggregates import first_per
from hydropanel.operators.joins import with_prior
from hydropanel.operators.reshape import to_wide

SEASON_PRECIP = {"SON": "fall_precip", "DJF": "winter_precip", "MAM": "spring_precip", "JJA": "summer_precip"}

# The month at which a season's total is picked up.
ANCHOR_MONTH = {"SON": 10, "DJF": 1, "MAM": 4, "JJA": 7}


def month_flow(daily: DataFrame, monthly: DataFrame, site: DataFrame) -> DataFrame:
    """Monthly mean flow of both agencies per water year, with its logarithm and region.

    ``daily`` is ``(site_number, date, value)`` in m3/s, ``monthly`` is
    ``(site_no, year_nu, month_nu, mean_va)`` in ft3/s by calendar year.
    """
    a = (
        daily.filter(F.col("value") > 0)
        .groupBy("site_number", calendar.water_year("date").alias("year"), F.month("date").alias("month"))
        .agg(F.avg("value").alias("mean_q"))
    )
    b = monthly.filter(F.col("mean_va") > 0).select(
        F.col("site_no").alias("site_number"),
        calendar.water_year_of("year_nu", "month_nu").alias("year"),
        F.col("month_nu").alias("month"),
        units.convert("mean_va", "ft3/s", "m3/s").alias("mean_q"),
    )
    flow = a.unionByName(b).withColumn("log_q", units.log10_safe("mean_q"))
    return flow.join(site.select("site_number", "cluster"), "site_number")


def season_panel(months: DataFrame, blend: bool = False) -> DataFrame:
    """Season panel from month rows.

    Input: ``site_number, cluster, year`` (water), ``cal_year, month, season, mean_q,
    precip_m, temp_k, area``, one row per station and month.  Output: one row per
    site, water year and season with log means of efficiency, flow and temperature,
    log precipitation of all four seasons, the own-season value and the values of
    the year before.

    Autumn precipitation is the total of a calendar autumn and counts for the next
    water year; ``blend`` averages the two autumns a water year touches instead.
    The month rows are shuffled once, by station (bounded by the months of a record);
    all windows below refine that partitioning and only sort.
    """
    m = months.filter((F.col("precip_m") > 0) & (F.col("mean_q") > 0)).withColumns(
        {
            "_runoff": units.runoff_ratio("mean_q", "area", "precip_m", units.SECONDS_MONTH),
            "_sy": calendar.season_year("season", "cal_year", "year"),
        }
    )
    m = m.repartition("site_number")
    season = Window.partitionBy("site_number", "season", "_sy")
    m = m.withColumns(
        {
            "season_runoff": units.log10_safe(F.avg("_runoff").over(season)),
            "season_q": units.log10_safe(F.avg("mean_q").over(season)),
            "season_temp": units.log10_safe(F.avg("temp_k").over(season)),
            "_total": F.sum("precip_m").over(season),
        }
    )
    # a season's total is picked up at its anchor month, and only if that month exists
    year = Window.partitionBy("site_number", "year")
    picked = {
        c: F.max(F.when(F.col("month") == ANCHOR_MONTH[s], F.col("_total"))).over(year) for s, c in SEASON_PRECIP.items()
    }
    if blend:
        autumns = F.avg(F.when(F.col("season") == "SON", F.col("_total"))).over(year)
        picked["fall_precip"] = F.when(picked["fall_precip"].isNotNull(), autumns)
    cols = list(SEASON_PRECIP.values())
    rows = m.withColumns(picked).na.drop(subset=cols).withColumns({c: units.log10_safe(c) for c in cols})
    own = F.lit(None).cast("double")
    for name, col in SEASON_PRECIP.items():
        own = F.when(F.col("season") == name, F.col(col)).otherwise(own)
    rows = rows.withColumn("season_precip", own)
    prior = with_prior(rows, ["site_number", "month"], "year", {c: f"prior_{c}" for c in cols})
    first = first_per(prior.filter(F.col("prior_summer_precip").isNotNull()), ["site_number", "year", "season"], ["month"])
    return first.select(
        "site_number", "cluster", "year", "cal_year", "season", "month",
        "season_q", "season_runoff", "season_temp", "season_precip",
        *cols, *[f"prior_{c}" for c in cols],
    )


def water_year_total(df: DataFrame, site: str, date: str, rate: str, scale: float = 1 / 1000) -> DataFrame:
    """Daily rate of each month to the total depth of a water year."""
    depth = calendar.month_depth(rate, F.month(date)) * F.lit(scale)
    return df.groupBy(site, calendar.water_year(date).alias("year")).agg(
        F.when(F.count(rate) == F.count(F.lit(1)), F.sum(depth)).alias("total")
    )


def water_year_mean(df: DataFrame, site: str, date: str, col: str) -> DataFrame:
    """Unweighted mean of the months of a water year."""
    return df.groupBy(site, calendar.water_year(date).alias("year")).agg(
        F.when(F.count(col) == F.count(F.lit(1)), F.avg(col)).alias("mean")
    )


def season_total(df: DataFrame, site: str, date: str, rate: str, scale: float = 1 / 1000, years=None) -> DataFrame:
    """Seasonal depth per site and season year; wide (``DJF_1980`` ...) for given years."""
    month = F.month(date)
    season = calendar.season(month)
    long = df.groupBy(
        site,
        season.alias("season"),
        calendar.season_year(season, F.year(date), calendar.water_year(date)).alias("season_year"),
    ).agg(F.sum(calendar.month_depth(rate, month) * F.lit(scale)).alias("total"))
    if years is None:
        return long
    names = [f"{s}_{y}" for s in calendar.SEASON_MONTHS for y in years]
    keyed = long.withColumn("_key", F.concat_ws("_", "season", F.col("season_year").cast("string")))
    return to_wide(keyed, [site], "_key", "total", names)
