"""Stacking, long and wide forms, user functions."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from hydropanel.operators import apply, reshape
from hydropanel.plans.registry import query


@query(
    "set_union_all",
    "SELECT c_custkey AS id, c_acctbal AS bal FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier",
)
def set_union_all(p):
    a = p.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"))
    b = p.table("supplier").select(F.col("s_acctbal").alias("bal"), F.col("s_suppkey").alias("id"))
    return reshape.stack([a, b])


@query(
    "set_union_fill",
    "SELECT c_custkey AS id, c_mktsegment AS segment, NULL::DOUBLE AS bal FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier",
)
def set_union_fill(p):
    a = p.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    b = p.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"))
    return reshape.stack([a, b], fill=True)


@query(
    "set_union_pos",
    "SELECT c_custkey, c_acctbal FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier",
)
def set_union_pos(p):
    return reshape.stack(
        [p.table("customer").select("c_custkey", "c_acctbal"), p.table("supplier").select("s_suppkey", "s_acctbal")],
        by_position=True,
    )


@query(
    "set_bind_list",
    """SELECT cluster, 'precip' AS series, avg(precip_m) AS mean_value, NULL::DOUBLE AS sd_value FROM panel_year GROUP BY 1
      UNION ALL SELECT cluster, 'temp', avg(temp_k), stddev_samp(temp_k) FROM panel_year GROUP BY 1""",
    "mean_value sd_value",
)
def set_bind_list(p):
    """Result tables with different columns under one another."""
    year = p.stage("panel_year")
    a = year.groupBy("cluster").agg(F.lit("precip").alias("series"), F.avg("precip_m").alias("mean_value"))
    b = year.groupBy("cluster").agg(
        F.lit("temp").alias("series"), F.avg("temp_k").alias("mean_value"), F.stddev_samp("temp_k").alias("sd_value")
    )
    return reshape.stack_results([a, b])


_YEARS = range(1995, 2003)
_WIDE_YEARS = ", ".join(f"max(CASE WHEN year = {y} THEN precip_m END) AS \"{y}\"" for y in _YEARS)


@query(
    "rsh_long_year",
    f"""SELECT site_number, CAST(year AS INTEGER) AS year, value FROM (
      SELECT site_number, unnest([{', '.join(str(y) for y in _YEARS)}]) AS year, unnest([{', '.join(f'"{y}"' for y in _YEARS)}]) AS value
      FROM (SELECT site_number, {_WIDE_YEARS} FROM panel_year GROUP BY 1))""",
    "value",
)
def rsh_long_year(p):
    """One column per year back to rows, nulls kept."""
    wide = reshape.to_wide(p.panel_year, ["site_number"], "year", "precip_m", _YEARS)
    return reshape.to_long_year(wide, ["site_number"], [str(y) for y in _YEARS])


_MONTHS = range(1, 13)


def _sql_wide(value: str, prefix: str) -> str:
    return ", ".join(f"max(CASE WHEN month = {m} THEN {value} END) AS {prefix}{m:02d}" for m in _MONTHS)


@query(
    "rsh_long_month",
    f"""SELECT site_number, cal_year, CAST(month AS INTEGER) AS month, value FROM (
      SELECT site_number, cal_year, unnest(range(1, 13)) AS month, unnest([{', '.join(f'Pcpt{m:02d}' for m in _MONTHS)}]) AS value
      FROM (SELECT site_number, cal_year, {_sql_wide('precip_m', 'Pcpt')} FROM panel_month GROUP BY 1, 2))""",
    "value",
)
def rsh_long_month(p):
    names = [f"{m:02d}" for m in _MONTHS]
    wide = reshape.to_wide(p.panel_month, ["site_number", "cal_year"], "month", {"precip_m": "Pcpt"}, _MONTHS, names)
    return reshape.to_long_month(wide, ["site_number", "cal_year"], [f"Pcpt{n}" for n in names], r"Pcpt(\d+)")


_HEADERS = [f"X{y}.{m:02d}.01" for y in range(1995, 2003) for m in _MONTHS]


@query(
    "rsh_long_month_date",
    """SELECT g.site_number, g.cal_year, g.month, temp_k AS value FROM (SELECT site_number, CAST(a AS INTEGER) AS cal_year, CAST(b AS INTEGER) AS month
      FROM site, range(1995, 2003) x(a), range(1, 13) y(b)) g
      LEFT JOIN panel_month p ON g.site_number = p.site_number AND g.cal_year = p.cal_year AND g.month = p.month""",
    "value",
)
def rsh_long_month_date(p):
    """Headers such as ``X1996.01.01``."""
    keyed = p.panel_month.withColumn("_h", F.format_string("X%d.%02d.01", "cal_year", "month"))
    safe = [h.replace(".", "_") for h in _HEADERS]
    wide = reshape.to_wide(keyed, ["site_number"], "_h", "temp_k", _HEADERS, safe)
    return reshape.to_long_month(wide, ["site_number"], safe, r"X(.*)", date_format="yyyy_MM_dd")


@query(
    "rsh_long_generic",
    """SELECT site_number, year, unnest(['mean_q', 'precip_m', 'temp_k']) AS variable,
      unnest([mean_q, precip_m, temp_k]) AS value FROM panel_year""",
    "value",
)
def rsh_long_generic(p):
    return reshape.to_long(p.panel_year.select("site_number", "year", "mean_q", "precip_m", "temp_k"), ["site_number", "year"])


_REGIME_SQL = ", ".join(f"max(CASE WHEN month = {m} THEN q END) AS {n}" for m, n in zip(_MONTHS, reshape.MONTH_NAMES))


@query(
    "rsh_wide_month",
    f"SELECT site_number, {_REGIME_SQL} FROM (SELECT site_number, month, avg(mean_q) AS q FROM panel_month GROUP BY 1, 2) GROUP BY 1",
    reshape.MONTH_NAMES,
)
def rsh_wide_month(p):
    means = p.panel_month.groupBy("site_number", "month").agg(F.avg("mean_q").alias("q"))
    return reshape.to_wide(means, ["site_number"], "month", "q", _MONTHS, reshape.MONTH_NAMES)


@query(
    "rsh_wide_siteyear",
    f"SELECT site_number, cal_year, {_sql_wide('precip_m', 'Pcpt')}, {_sql_wide('temp_k', 'Temp')} FROM panel_month GROUP BY 1, 2",
    [f"{v}{m:02d}" for v in ("Pcpt", "Temp") for m in _MONTHS],
)
def rsh_wide_siteyear(p):
    names = [f"{m:02d}" for m in _MONTHS]
    cols = {"precip_m": "Pcpt", "temp_k": "Temp"}
    return reshape.to_wide(p.panel_month, ["site_number", "cal_year"], "month", cols, _MONTHS, names)


@query(
    "rsh_stack_cols",
    "SELECT site_number, year, unnest([z_precip, z_temp]) AS value FROM z_year",
    "value",
)
def rsh_stack_cols(p):
    return reshape.stack_cols(p.z_year, ["site_number", "year"], ["z_precip", "z_temp"])


@query(
    "udf_group_apply",
    """SELECT cluster, count(*) AS n, regr_slope(z_log_runoff, z_precip) AS slope FROM region_year
      WHERE z_log_runoff IS NOT NULL AND z_precip IS NOT NULL GROUP BY cluster""",
    "slope",
)
def udf_group_apply(p):
    """A user's own fit per region on its yearly rows (the rows are already reduced)."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna()
        x, y = pdf["z_precip"] - pdf["z_precip"].mean(), pdf["z_log_runoff"]
        return pd.DataFrame({"cluster": [pdf["cluster"].iloc[0]], "n": [len(pdf)], "slope": [(x * y).sum() / (x * x).sum()]})

    df = p.region_year.select("cluster", "z_log_runoff", "z_precip")
    return apply.group_apply(df, ["cluster"], fit, "cluster int, n long, slope double")


@query(
    "udf_group_stream",
    """SELECT site_number, count(*) AS n, max(gap) AS longest_gap FROM (SELECT site_number,
      date - lag(date) OVER (PARTITION BY site_number ORDER BY date) AS gap FROM obs) GROUP BY site_number""",
)
def udf_group_stream(p):
    """Measurements of a station and the most days between two that follow each other, batch by batch."""

    def gaps(key, batches):
        n, last, longest = 0, None, None
        for batch in batches:
            days = batch.column("date").cast(pa.int32()).to_numpy()
            n += len(days)
            steps = np.diff(days if last is None else np.append(last, days))
            if len(steps):
                longest = max(int(steps.max()), -1 if longest is None else longest)
            last = days[-1] if len(days) else last
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.string()), pa.array([n], pa.int64()), pa.array([longest], pa.int64())], names=["site_number", "n", "longest_gap"]
        )

    return apply.group_stream(p.obs.select("site_number", "date"), ["site_number"], gaps, "site_number string, n long, longest_gap long", order=["date"])


@query(
    "udf_map_collection",
    """SELECT site_number, cal_year, CAST(count(m.month) AS BIGINT) AS n_months, coalesce(sum(m.precip_m), 0) AS total
      FROM (SELECT site_number, unnest(range(1995, 2002)) AS cal_year FROM site)
      LEFT JOIN panel_month m USING (site_number, cal_year) GROUP BY 1, 2""",
    "total",
)
def udf_map_collection(p):
    """A feature per station and year, mapped over the list of years and flattened."""
    months = p.panel_month.groupBy("site_number").agg(
        # bounded by the number of months of a record
        F.collect_list(F.struct("cal_year", "precip_m")).alias("months")
    )
    base = p.site.select("site_number").join(months, "site_number", "left")

    def feature(year):
        own = F.filter(F.col("months"), lambda m: m["cal_year"] == year)
        own = F.coalesce(own, F.filter(F.array(F.struct(F.lit(0).alias("cal_year"), F.lit(0.0).alias("precip_m"))), lambda m: F.lit(False)))
        total = F.aggregate(own, F.lit(0.0), lambda s, m: s + m["precip_m"])
        return F.struct(year.alias("cal_year"), F.size(own).cast("long").alias("n_months"), total.alias("total"))

    years = F.sequence(F.lit(1995).cast("long"), F.lit(2001).cast("long"))
    return apply.map_collection(base, years, "features", feature).select("site_number", "cal_year", "n_months", "total")
