"""Grouped aggregates."""

from pyspark.sql import functions as F

from hydropanel.operators import aggregates, seasonal, state
from hydropanel.operators.windows import share_of_peak
from hydropanel.plans.registry import query


@query("agg_mean", "SELECT event_type, avg(value) AS value FROM events GROUP BY event_type", "value")
def agg_mean(p):
    return aggregates.group_mean(p.table("events"), ["event_type"], ["value"])


@query(
    "agg_mean_sd",
    "SELECT cluster, avg(runoff_ratio) AS runoff_mean, stddev_samp(runoff_ratio) AS runoff_sd FROM panel_year GROUP BY cluster",
    "runoff_mean runoff_sd",
)
def agg_mean_sd(p):
    return aggregates.group_mean_sd(p.panel_year, ["cluster"], {"runoff_ratio": ("runoff_mean", "runoff_sd")}, na_rm=False)


@query(
    "agg_sum",
    """SELECT site_number, year, season, CASE WHEN count(precip_m) = count(*) THEN sum(precip_m) END AS total
      FROM panel_month GROUP BY 1, 2, 3""",
    "total",
)
def agg_sum(p):
    return aggregates.group_sum(p.panel_month, ["site_number", "year", "season"], {"precip_m": "total"})


@query(
    "agg_minmax",
    "SELECT l_suppkey, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY l_suppkey",
    "lo hi",
)
def agg_minmax(p):
    return aggregates.group_min_max(p.table("lineitem"), ["l_suppkey"], {"l_extendedprice": ("lo", "hi")})


@query(
    "agg_record_span",
    """SELECT site_number, max(gap) AS max_gap, min(t) AS first_year, max(t) AS last_year FROM (
      SELECT site_number, t, t - lag(t) OVER (PARTITION BY site_number ORDER BY t) AS gap
      FROM (SELECT DISTINCT site_number, t FROM panel_month)) GROUP BY site_number
      HAVING max(gap) <= 2 AND min(t) <= 23941 AND max(t) >= 24023""",
)
def agg_record_span(p):
    """Months instead of years: the driver tables span seven years only."""
    return aggregates.record_span(p.panel_month, year="t", max_gap=2, first_by=23941, last_from=24023)


@query(
    "agg_cond_fraction",
    "SELECT user_id, count(*) FILTER (value <= 20) / count(*) AS fraction FROM events GROUP BY user_id",
    "fraction",
)
def agg_cond_fraction(p):
    return aggregates.fraction(p.table("events"), ["user_id"], F.col("value") <= 20)


@query(
    "agg_distinct_first",
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_shipdate FROM lineitem
      QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) = 1""",
)
def agg_distinct_first(p):
    df = p.table("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate")
    return aggregates.first_per(df, ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber"])


@query("agg_distinct_vals", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def agg_distinct_vals(p):
    return aggregates.distinct_values(p.table("lineitem"), ["l_suppkey", "l_returnflag"])


@query(
    "agg_two_level",
    """SELECT DISTINCT site_number, cluster, avg(precip_m) OVER (PARTITION BY site_number) AS site_mean,
      avg(precip_m) OVER (PARTITION BY cluster) AS region_mean FROM panel_year""",
    "site_mean region_mean",
)
def agg_two_level(p):
    return aggregates.two_level_mean(p.panel_year, "site_number", "cluster", "precip_m")


_Z = "z_q z_log_runoff z_runoff z_precip z_off_precip z_temp z_off_temp"


@query("agg_nested_mean", "SELECT * FROM region_year", _Z)
def agg_nested_mean(p):
    return p.region_year


@query(
    "agg_stats_table",
    """SELECT cluster, year, mu_z_log_runoff, sd_z_log_runoff, mu_z_precip, sd_z_precip, mu_runoff, sd_runoff, mu_precip, sd_precip
      FROM (SELECT cluster, year, avg(z_log_runoff) AS mu_z_log_runoff, stddev_samp(z_log_runoff) AS sd_z_log_runoff,
        avg(z_precip) AS mu_z_precip, stddev_samp(z_precip) AS sd_z_precip FROM z_year GROUP BY 1, 2)
      JOIN (SELECT cluster, year, avg(runoff_ratio) AS mu_runoff, stddev_samp(runoff_ratio) AS sd_runoff,
        avg(precip_m) AS mu_precip, stddev_samp(precip_m) AS sd_precip FROM z_year GROUP BY 1, 2) USING (cluster, year)""",
    "mu_z_log_runoff sd_z_log_runoff mu_z_precip sd_z_precip mu_runoff sd_runoff mu_precip sd_precip",
)
def agg_stats_table(p):
    return aggregates.stats_table(
        p.z_year,
        p.z_year,
        ["cluster", "year"],
        {"z_log_runoff": ("mu_z_log_runoff", "sd_z_log_runoff"), "z_precip": ("mu_z_precip", "sd_z_precip")},
        {"runoff_ratio": ("mu_runoff", "sd_runoff"), "precip_m": ("mu_precip", "sd_precip")},
    )


@query(
    "agg_stats_table_raw",
    """SELECT * FROM (SELECT cluster, year, avg(z_log_runoff) AS mu_z, stddev_samp(z_log_runoff) AS sd_z FROM z_year GROUP BY 1, 2)
      JOIN (SELECT cluster, year, avg(runoff_ratio) AS mu_runoff, stddev_samp(runoff_ratio) AS sd_runoff FROM panel_year GROUP BY 1, 2)
      USING (cluster, year)""",
    "mu_z sd_z mu_runoff sd_runoff",
)
def agg_stats_table_raw(p):
    """Scores and raw values from two tables: station years without a prior year count among the raw values only."""
    year = p.stage("panel_year")
    return aggregates.stats_table(
        p.scores(year, "year"), year, ["cluster", "year"], {"z_log_runoff": ("mu_z", "sd_z")}, {"runoff_ratio": ("mu_runoff", "sd_runoff")}
    )


_MONTH_FLOW = """SELECT site_number, year, month, mean_q, log10(mean_q) AS log_q, cluster FROM (
  SELECT site_number, {wy} AS year, CAST(month(date) AS INTEGER) AS month, avg(mean_q) AS mean_q
  FROM daily WHERE length(site_number) < 2 AND mean_q > 0 GROUP BY 1, 2, 3
  UNION ALL SELECT site_number, year, month, mean_q * CAST(0.028316846592 AS DOUBLE) FROM panel_month WHERE length(site_number) >= 2)
  JOIN (SELECT site_number, cluster FROM site) USING (site_number)""".format(
    wy="CAST(year(date) + CASE WHEN month(date) > 9 THEN 1 ELSE 0 END AS INTEGER)"
)


@query("agg_month_flow", _MONTH_FLOW, "mean_q log_q")
def agg_month_flow(p):
    """One agency delivers daily values, the other monthly means."""
    daily = p.daily.filter(F.length("site_number") < 2).select("site_number", "date", F.col("mean_q").alias("value"))
    monthly = p.panel_month.filter(F.length("site_number") >= 2).select(
        F.col("site_number").alias("site_no"), F.col("cal_year").alias("year_nu"),
        F.col("month").alias("month_nu"), F.col("mean_q").alias("mean_va"),
    )
    return seasonal.month_flow(daily, monthly, p.site)


@query("udf_month_apply", f"SELECT month, count(*) AS n, avg(log_q) AS log_q FROM ({_MONTH_FLOW}) GROUP BY month", "log_q")
def udf_month_apply(p):
    """What was a loop over months is one grouped job."""
    return agg_month_flow(p).groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.avg("log_q").alias("log_q"))


_SEASON = (
    "season_q season_runoff season_temp season_precip fall_precip winter_precip spring_precip summer_precip "
    "prior_fall_precip prior_winter_precip prior_spring_precip prior_summer_precip"
)


@query("agg_season_panel", "SELECT * FROM season_values", _SEASON)
def agg_season_panel(p):
    return p.season_values


@query(
    "agg_season_panel_blend",
    """SELECT a.site_number, a.year, a.season, a.fall_precip FROM (SELECT v.site_number, v.year, v.season, f.fall_precip FROM season_values v JOIN blended f USING (site_number, year)) a""",
    "fall_precip",
    {
        "autumns": "SELECT site_number, sy, sum(precip_m) AS total FROM season_months WHERE season = 'SON' GROUP BY 1, 2",
        "blended": """SELECT m.site_number, m.year, log10(avg(total)) AS fall_precip FROM season_months m
          JOIN autumns USING (site_number, sy) WHERE m.season = 'SON' GROUP BY 1, 2 HAVING count(*) FILTER (m.month = 10) > 0""",
    },
)
def agg_season_panel_blend(p):
    """Autumn precipitation as the mean of the two autumns a water year touches."""
    return seasonal.season_panel(p.panel_month, blend=True).select("site_number", "year", "season", "fall_precip")


_GRAM_SQL = """SELECT cluster, count(*) AS n, avg(z_log_runoff) AS mean_y, covar_samp(z_log_runoff, z_precip) AS cov_yp,
      var_samp(z_precip) AS cov_pp, covar_samp(z_precip, z_temp) AS cov_pt FROM region_month
      WHERE z_log_runoff IS NOT NULL AND z_precip IS NOT NULL AND z_temp IS NOT NULL GROUP BY cluster"""
_GRAM = ["z_log_runoff", "z_precip", "z_temp"]


def _some_moments(g):
    at = F.col("cov")
    return g.select(
        "cluster", "n", F.col("mean")[0].alias("mean_y"), at[1].alias("cov_yp"), at[4].alias("cov_pp"), at[5].alias("cov_pt")
    )


@query("agg_gram", _GRAM_SQL, "mean_y cov_yp cov_pp cov_pt")
def agg_gram(p):
    return _some_moments(aggregates.gram(p.region_month, ["cluster"], _GRAM))


@query("agg_gram_state", _GRAM_SQL, "mean_y cov_yp cov_pp cov_pt")
def agg_gram_state(p):
    """The same from a stored state: all years with one of them wrong, then that year corrected."""
    return _some_moments(state.moments(state.merged(p.corrected_state(["cluster"], _GRAM), ["cluster"]), ["cluster"], len(_GRAM)))


@query(
    "win_share_of_peak",
    """SELECT site_number, year, month, month_peak, max(month_peak) OVER (PARTITION BY site_number, year) AS year_peak,
      month_peak / max(month_peak) OVER (PARTITION BY site_number, year) AS share FROM (
      SELECT site_number, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, max(q_cfs) AS month_peak
      FROM obs GROUP BY 1, 2, 3)""",
    "month_peak year_peak share",
)
def win_share_of_peak(p):
    df = p.obs.select("site_number", F.year("date").alias("year"), F.month("date").alias("month"), "q_cfs")
    return share_of_peak(df, "site_number", "year", "month", "q_cfs")
