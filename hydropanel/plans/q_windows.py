"""Values kept on every row."""

from pyspark.sql import functions as F

from hydropanel.operators import ranges, windows
from hydropanel.plans.registry import query


@query(
    "win_part_agg",
    """SELECT event_id, user_id, value, avg(value) OVER (PARTITION BY user_id) AS mean_value,
      count(*) OVER (PARTITION BY user_id) AS n FROM events""",
    "value mean_value",
)
def win_part_agg(p):
    df = p.table("events").select("event_id", "user_id", "value")
    return windows.add_group_agg(df, ["user_id"], {"mean_value": F.avg("value"), "n": F.count(F.lit(1))})


@query(
    "win_lag_diff",
    "SELECT site_number, t, t - lag(t) OVER (PARTITION BY site_number ORDER BY t) AS gap FROM panel_month",
)
def win_lag_diff(p):
    return windows.gap(p.panel_month.select("site_number", "t"), "site_number", "t")


@query(
    "win_lead",
    "SELECT site_number, year, runoff_ratio, lead(runoff_ratio) OVER (PARTITION BY site_number ORDER BY year) AS next_ratio FROM panel_year",
    "runoff_ratio next_ratio",
)
def win_lead(p):
    df = p.panel_year.select("site_number", "year", "runoff_ratio")
    return windows.shift(df, ["site_number"], ["year"], "runoff_ratio", 1, "next_ratio")


@query(
    "win_roll_center",
    """SELECT cluster, t, z_precip, CASE WHEN count(z_precip) OVER w = 5 THEN avg(z_precip) OVER w END AS smooth FROM region_month
      WINDOW w AS (PARTITION BY cluster ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""",
    "z_precip smooth",
)
def win_roll_center(p):
    df = p.region_month.select("cluster", "t", "z_precip")
    return windows.centered_mean(df, ["cluster"], ["t"], {"z_precip": "smooth"}, 5)


@query(
    "win_long_series",
    """SELECT series, event_id, value, event_id - lag(event_id) OVER w AS gap, lead(value, 3) OVER w AS later,
      CASE WHEN count(value) OVER f = 5 THEN avg(value) OVER f END AS smooth
      FROM (SELECT *, CASE WHEN event_type IN ('click', 'error', 'view') THEN 'long' ELSE event_type END AS series FROM events)
      WINDOW w AS (PARTITION BY series ORDER BY event_id), f AS (PARTITION BY series ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""",
    "value later smooth",
)
def win_long_series(p):
    """Lag, lead and centred mean where one series has most of the rows, by ranges of it."""
    kind = F.col("event_type")
    df = p.table("events").select(F.when(kind.isin("click", "error", "view"), "long").otherwise(kind).alias("series"), "event_id", "value")

    def values(w):
        around = w.rowsBetween(-2, 2)
        return {
            "gap": F.col("event_id") - F.lag("event_id").over(w),
            "later": F.lead("value", 3).over(w),
            "smooth": F.when(F.count("value").over(around) == 5, F.avg("value").over(around)),
        }

    return ranges.over(df, ["series"], "event_id", values, 2, 3, range_rows=2_000)


@query(
    "win_residual",
    """SELECT cluster, year, region_q, region_q - sum(n * region_q) OVER (PARTITION BY cluster) / sum(n) OVER (PARTITION BY cluster) AS residual
      FROM (SELECT cluster, year, avg(mean_q) AS region_q, count(*) AS n FROM panel_year GROUP BY 1, 2)""",
    "region_q residual",
)
def win_residual(p):
    """Region mean flow of a year minus the row-weighted mean over the years."""
    years = p.panel_year.groupBy("cluster", "year").agg(F.avg("mean_q").alias("region_q"), F.count("mean_q").alias("n"))
    return windows.residual(years, ["cluster"], "region_q", "residual", weight="n", period="year").drop("n")


@query(
    "win_first",
    """SELECT site_number, year, max(abs(temp_c)) OVER (PARTITION BY site_number) > 4.5 AS any_nonzero FROM (
      SELECT site_number, year, temp_k - CAST(273.15 AS DOUBLE) AS temp_c FROM panel_year)""",
)
def win_first(p):
    over = F.when(F.abs(F.col("temp_k") - 273.15) > 4.5, 1).otherwise(0)
    out = windows.any_nonzero(p.panel_year.withColumn("over", over), ["site_number"], "over", period="year")
    return out.select("site_number", "year", "any_nonzero")


_Z = "z_q z_log_runoff z_runoff z_precip z_off_precip z_temp z_off_temp"


@query("win_zscore", f"SELECT site_number, cluster, year, {_Z.replace(' ', ', ')} FROM z_year", _Z)
def win_zscore(p):
    return p.z_year.select("site_number", "cluster", "year", *_Z.split())


_ZS = (
    "z_season_q z_season_runoff z_fall_precip z_winter_precip z_spring_precip z_summer_precip z_prior_summer_precip"
)


@query("win_zscore_season", f"SELECT site_number, cluster, season, year, {_ZS.replace(' ', ', ')} FROM z_season", _ZS)
def win_zscore_season(p):
    return p.z_season.select("site_number", "cluster", "season", "year", *_ZS.split())


@query(
    "win_unzscore",
    """SELECT site_number, year, back FROM (SELECT *, avg(log_runoff) OVER w + (z_log_runoff / 2 + 1) * stddev_samp(log_runoff) OVER w AS back
      FROM z_year WINDOW w AS (PARTITION BY site_number)) WHERE back IS NOT NULL""",
    "back",
)
def win_unzscore(p):
    """Changed scores (as a model gives them) in the unit of the values."""
    z = p.z_year.select("site_number", "year", "log_runoff", (F.col("z_log_runoff") / 2 + 1).alias("z_log_runoff"))
    out = windows.unzscore(z, ["site_number"], {"z_log_runoff": "back"}, "log_runoff", period="year")
    return out.filter(F.col("back").isNotNull()).select("site_number", "year", "back")


@query("region_season_mean", "SELECT * FROM region_season", _ZS)
def region_season_mean(p):
    return p.region_season
