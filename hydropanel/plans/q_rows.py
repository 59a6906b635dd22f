"""Projections, filters, null rules, column updates."""

from pyspark.sql import functions as F

from hydropanel.functions import units
from hydropanel.operators import joins, rows
from hydropanel.plans.registry import query


@query("prj_select", "SELECT l_suppkey, l_shipdate, l_quantity FROM lineitem")
def prj_select(p):
    return rows.keep(p.table("lineitem"), ["l_suppkey", "l_shipdate", "l_quantity"])


@query("prj_drop", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders")
def prj_drop(p):
    return rows.drop_cols(p.table("orders"), ["o_orderstatus", "o_orderpriority", "absent"])


@query("prj_rename", "SELECT s_suppkey AS site_no, s_name, s_nationkey, s_acctbal AS value FROM supplier")
def prj_rename(p):
    return rows.rename(p.table("supplier"), {"s_suppkey": "site_no", "s_acctbal": "value", "absent": "gone"})


@query("prj_position", "SELECT p_partkey, p_name, p_brand, p_retailprice FROM part")
def prj_position(p):
    return rows.cols_at(p.table("part"), [(1, 3), 6])


@query(
    "prj_derive",
    """SELECT site_number, date, q_cfs * CAST(0.028316846592 AS DOUBLE) AS q_cms, precip / 1000 AS precip_m,
      CAST(273.15 AS DOUBLE) + 100 * discount AS temp_k FROM obs""",
    "q_cms precip_m temp_k",
)
def prj_derive(p):
    out = rows.derive(
        p.obs,
        {
            "q_cms": units.convert("q_cfs", "ft3/s", "m3/s"),
            "precip_m": F.col("precip") / 1000,
            "temp_k": units.convert(100 * F.col("discount"), "C", "K"),
        },
    )
    return out.select("site_number", "date", "q_cms", "precip_m", "temp_k")


@query(
    "prj_cond_update",
    """SELECT event_id, event_type, CASE WHEN value > 50 THEN value - 50 ELSE value END AS value,
      CASE WHEN value > 50 THEN 'high' END AS level FROM events""",
    "value",
)
def prj_cond_update(p):
    df = p.table("events").select("event_id", "event_type", "value")
    # the label first: the update below changes the tested value
    high = F.col("value") > 50
    return rows.update_where(df, high, {"level": F.lit("high"), "value": F.col("value") - 50})


_PRECIP = {"SON": "fall_precip", "DJF": "winter_precip", "MAM": "spring_precip", "JJA": "summer_precip"}


@query(
    "prj_dynamic_col",
    """SELECT site_number, year, season, CASE season WHEN 'SON' THEN fall_precip WHEN 'DJF' THEN winter_precip
      WHEN 'MAM' THEN spring_precip ELSE summer_precip END AS own FROM season_values""",
    "own",
)
def prj_dynamic_col(p):
    return rows.pick_col(p.season_values, "season", _PRECIP, "own").select("site_number", "year", "season", "own")


@query("prj_const", "SELECT c_custkey, c_acctbal, 'WSC' AS agency FROM customer")
def prj_const(p):
    return rows.tag(p.table("customer").select("c_custkey", "c_acctbal"), "agency", "WSC")


@query("flt_range", "SELECT site_number, year, mean_q FROM panel_year WHERE year BETWEEN 1996 AND 2000", "mean_q")
def flt_range(p):
    part = p.only(lambda facts: rows.in_water_years(facts, "l_shipdate", 1996, 2000))
    return rows.between_years(part.panel_year.select("site_number", "year", "mean_q"), 1996, 2000)


@query("flt_positive", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def flt_positive(p):
    return rows.positive(p.table("customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])


@query("flt_in", "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey NOT IN (1, 2, 3, 17)")
def flt_in(p):
    return rows.is_in(p.table("supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", [1, 2, 3, 17], negate=True)


@query("flt_length", "SELECT site_number, length(site_number) >= 2 AS long_id FROM site")
def flt_length(p):
    long_id, short_id = rows.split_by_length(p.site.select("site_number"), "site_number", 2)
    return rows.tag(long_id, "long_id", True).unionByName(rows.tag(short_id, "long_id", False))


@query("flt_eq_item", "SELECT site_number, year, runoff_ratio FROM panel_year WHERE site_number = '7'", "runoff_ratio")
def flt_eq_item(p):
    part = p.only(lambda facts: rows.one_site(facts, 7, "l_suppkey"))
    return rows.one_site(part.panel_year.select("site_number", "year", "runoff_ratio"), "7")


@query(
    "flt_date_window",
    "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'",
)
def flt_date_window(p):
    return rows.in_year(p.table("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), "l_shipdate", 1997)


@query("flt_ne", "SELECT site_number, year, precip_m FROM panel_year WHERE year <> 1997", "precip_m")
def flt_ne(p):
    part = p.only(lambda facts: rows.not_in_water_year(facts, "l_shipdate", 1997))
    return rows.exclude(part.panel_year.select("site_number", "year", "precip_m"), "year", 1997)


@query(
    "flt_bool",
    """SELECT cluster, season_precip, season_runoff, r FROM (
      SELECT cluster, season AS season_runoff, unnest(['SON','DJF','MAM','JJA']) AS season_precip,
        unnest([corr(season_runoff, fall_precip), corr(season_runoff, winter_precip),
                corr(season_runoff, spring_precip), corr(season_runoff, summer_precip)]) AS r
      FROM season_values GROUP BY cluster, season)
      WHERE (season_precip = 'SON') OR (season_precip = 'DJF' AND season_runoff IN ('DJF','MAM','JJA'))
        OR (season_precip = 'MAM' AND season_runoff IN ('MAM','JJA')) OR (season_precip = 'JJA' AND season_runoff = 'JJA')""",
    "r",
)
def flt_bool(p):
    """Correlations of every season pair that respects time."""
    one = [F.struct(F.lit(s).alias("season_precip"), F.corr("season_runoff", c).alias("r")) for s, c in _PRECIP.items()]
    pairs = p.season_values.groupBy("cluster", "season").agg(F.array(*one).alias("a"))
    pairs = pairs.select("cluster", F.col("season").alias("season_runoff"), F.inline("a"))
    return rows.causal_pairs(pairs, "season_precip", "season_runoff")


def _with_gaps(p):
    """Monthly panel with the month before, NULL after a gap."""
    base = p.panel_month.select("site_number", "t", "mean_q", "precip_m")
    return joins.with_prior(base, ["site_number"], "t", {"precip_m": "off_precip"}, how="left")


_GAPS = """SELECT a.site_number, a.t, a.mean_q, a.precip_m, b.precip_m AS off_precip FROM panel_month a
  LEFT JOIN panel_month b ON a.site_number = b.site_number AND a.t = b.t + 1"""


@query("nul_omit", f"SELECT * FROM ({_GAPS}) WHERE off_precip IS NOT NULL", "mean_q precip_m off_precip")
def nul_omit(p):
    return rows.complete(_with_gaps(p), ["off_precip"])


@query("nul_zero", f"SELECT * REPLACE (coalesce(off_precip, 0) AS off_precip) FROM ({_GAPS})", "mean_q precip_m off_precip")
def nul_zero(p):
    return rows.zero_nulls(_with_gaps(p), ["off_precip"])


@query("nul_sentinel", f"SELECT site_number, t, greatest(precip_m, off_precip) AS largest FROM ({_GAPS})", "largest")
def nul_sentinel(p):
    return _with_gaps(p).select("site_number", "t", units.max_of("precip_m", "off_precip").alias("largest"))


@query(
    "nul_outlier",
    "SELECT site_number, year, CASE WHEN abs(mean_q * 10) < 9999 THEN mean_q * 10 END AS q FROM panel_year",
    "q",
)
def nul_outlier(p):
    return p.panel_year.select("site_number", "year", units.null_if_beyond(F.col("mean_q") * 10).alias("q"))


@query("srt_order", "SELECT site_number, year, mean_q FROM panel_year ORDER BY year DESC, site_number", "mean_q")
def srt_order(p):
    return rows.ordered(p.panel_year.select("site_number", "year", "mean_q"), ["-year", "site_number"])


@query(
    "srt_display",
    """SELECT season, CASE season WHEN 'MAM' THEN 1 WHEN 'JJA' THEN 2 WHEN 'SON' THEN 3 ELSE 4 END AS "order", count(*) AS n
      FROM panel_month GROUP BY season ORDER BY 2""",
)
def srt_display(p):
    counts = p.panel_month.groupBy("season").agg(F.count(F.lit(1)).alias("n"))
    return rows.ordered(rows.display_order(counts, "season", {"MAM": 1, "JJA": 2, "SON": 3, "DJF": 4}), ["order"])


@query("lim_first", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5")
def lim_first(p):
    return rows.first_n(p.table("customer").select("c_custkey", "c_acctbal"), ["-c_acctbal", "c_custkey"], 5)
