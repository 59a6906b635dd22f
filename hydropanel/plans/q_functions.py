"""Scalar functions."""

from pyspark.sql import functions as F

from hydropanel.functions import calendar, dist, text, units
from hydropanel.plans import oracle
from hydropanel.plans.registry import query


@query(
    "fn_water_year",
    """SELECT l_orderkey, l_linenumber, CAST(year(l_shipdate) + (month(l_shipdate) > 9)::INT AS INTEGER) AS wy9,
      CAST(year(l_shipdate) + (month(l_shipdate) > 8)::INT AS INTEGER) AS wy8 FROM lineitem""",
)
def fn_water_year(p):
    d = "l_shipdate"
    return p.table("lineitem").select(
        "l_orderkey", "l_linenumber", calendar.water_year(d).alias("wy9"), calendar.water_year(d, 8).alias("wy8")
    )


@query(
    "fn_season",
    f"SELECT o_orderkey, {oracle.SEASON} AS season FROM (SELECT o_orderkey, month(o_orderdate) AS month FROM orders)",
)
def fn_season(p):
    return p.table("orders").select("o_orderkey", calendar.season(F.month("o_orderdate")).alias("season"))


@query(
    "fn_season_year",
    """SELECT site_number, cal_year, month, CASE WHEN season = 'SON' THEN cal_year ELSE year END AS season_year FROM panel_month""",
)
def fn_season_year(p):
    return p.panel_month.select(
        "site_number", "cal_year", "month", calendar.season_year("season", "cal_year", "year").alias("season_year")
    )


@query("fn_date_parts", "SELECT event_id, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month FROM events")
def fn_date_parts(p):
    parts = calendar.date_parts("ts")
    return p.table("events").select("event_id", *[c.alias(n) for n, c in parts.items()])


@query(
    "fn_date_parse",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS iso, CAST(date_trunc('month', o_orderdate) AS DATE) AS dotted,
      DATE '1899-12-30' + CAST(10000 + o_orderkey % 30000 AS INTEGER) AS serial, NULL::DATE AS bad FROM orders""",
)
def fn_date_parse(p):
    d = F.col("o_orderdate")
    return p.table("orders").select(
        "o_orderkey",
        calendar.parse_date(F.date_format(d, "yyyy-MM-dd")).alias("iso"),
        calendar.parse_date(F.date_format(d, "yyyy.MM.'01'"), "yyyy.MM.dd").alias("dotted"),
        calendar.excel_date(10000 + F.col("o_orderkey") % 30000).alias("serial"),
        calendar.parse_date(F.concat(F.lit("x"), d.cast("string"))).alias("bad"),
    )


@query(
    "fn_year_seq",
    "SELECT site_number, CAST(unnest(range(min(year), max(year) + 1)) AS INTEGER) AS year FROM panel_year GROUP BY site_number",
)
def fn_year_seq(p):
    span = p.panel_year.groupBy("site_number").agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    return span.select("site_number", F.explode(calendar.years(F.col("lo"), F.col("hi"))).alias("year"))


@query("fn_strip_prefix", "SELECT s_suppkey, replace(s_name, 'Supplier#', '') AS id FROM supplier")
def fn_strip_prefix(p):
    return p.table("supplier").select("s_suppkey", text.strip("s_name", "Supplier#").alias("id"))


@query(
    "fn_pad_id",
    "SELECT o_orderkey, CASE WHEN length(id) < 4 THEN '0' || id ELSE id END AS id FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS id FROM orders)",
)
def fn_pad_id(p):
    return p.table("orders").select("o_orderkey", text.pad_id(F.col("o_orderkey").cast("string"), 4).alias("id"))


@query("fn_paste", "SELECT site_number, t, season || '_' || CAST(year AS VARCHAR) AS label FROM panel_month")
def fn_paste(p):
    return p.panel_month.select("site_number", "t", text.label(["season", "year"]).alias("label"))


@query(
    "fn_unit",
    """SELECT l_orderkey, l_linenumber, l_extendedprice * CAST(0.028316846592 AS DOUBLE) AS cms, l_quantity / CAST(39.37 AS DOUBLE) AS inch_m,
      l_quantity / CAST(3.281 AS DOUBLE) AS foot_m, l_quantity / 1000 AS mm_m, l_tax * 1000000 AS m2,
      100 * l_discount + CAST(273.15 AS DOUBLE) AS kelvin FROM lineitem""",
    "cms inch_m foot_m mm_m m2 kelvin",
)
def fn_unit(p):
    return p.table("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        units.convert("l_extendedprice", "ft3/s", "m3/s").alias("cms"),
        units.convert("l_quantity", "in", "m").alias("inch_m"),
        units.convert("l_quantity", "ft", "m").alias("foot_m"),
        units.convert("l_quantity", "mm", "m").alias("mm_m"),
        units.convert("l_tax", "km2", "m2").alias("m2"),
        units.convert(100 * F.col("l_discount"), "C", "K").alias("kelvin"),
    )


@query(
    "fn_runoff_ratio",
    """SELECT site_number, date, mean_q * 31536000 / area / nullif(precip_m, 0) AS yearly,
      mean_q * CAST(2628002.88 AS DOUBLE) / area / nullif(precip_m, 0) AS monthly FROM daily JOIN site USING (site_number)""",
    "yearly monthly",
)
def fn_runoff_ratio(p):
    df = p.daily.join(p.site, "site_number")
    return df.select(
        "site_number",
        "date",
        units.runoff_ratio("mean_q", "area", "precip_m").alias("yearly"),
        units.runoff_ratio("mean_q", "area", "precip_m", units.SECONDS_MONTH).alias("monthly"),
    )


@query(
    "fn_log10",
    "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN log10(c_acctbal) END AS v FROM customer",
    "v",
)
def fn_log10(p):
    return p.table("customer").select("c_custkey", units.log10_safe("c_acctbal").alias("v"))


@query("fn_pow10", "SELECT l_orderkey, l_linenumber, pow(10, l_tax * 10) AS v FROM lineitem", "v")
def fn_pow10(p):
    return p.table("lineitem").select("l_orderkey", "l_linenumber", units.pow10(F.col("l_tax") * 10).alias("v"))


@query("fn_ln", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END AS v FROM customer", "v")
def fn_ln(p):
    return p.table("customer").select("c_custkey", units.ln_safe("c_acctbal").alias("v"))


@query(
    "fn_days_weight",
    f"SELECT site_number, t, precip_m * ({oracle.DAYS}) AS depth FROM panel_month",
    "depth",
)
def fn_days_weight(p):
    return p.panel_month.select("site_number", "t", calendar.month_depth("precip_m", "month").alias("depth"))


@query("fn_flip_depth", "SELECT site_number, date, 5 - well_m AS elevation FROM daily", "elevation")
def fn_flip_depth(p):
    return p.daily.select("site_number", "date", units.depth_to_elev("well_m").alias("elevation"))


@query(
    "fn_norm_share",
    """SELECT site_number, year, z_precip / (abs(z_precip) + abs(z_temp)) AS share,
      sign(z_q) * (z_precip / (z_precip + z_temp)) / (abs(z_precip / (z_precip + z_temp)) + abs(z_temp / (z_precip + z_temp))) AS directed
      FROM z_year""",
    "share directed",
)
def fn_norm_share(p):
    return p.z_year.select(
        "site_number",
        "year",
        units.signed_share("z_precip", "z_temp").alias("share"),
        units.directed_share("z_precip", "z_temp", "z_q").alias("directed"),
    )


@query(
    "fn_sign_label",
    """SELECT event_id, CASE WHEN value - 50 > 0 THEN 'Positive' ELSE 'Inverse' END AS sign,
      CASE WHEN value > 90 THEN 'Insignificant' WHEN value / 100 > CAST(0.05 AS DOUBLE) THEN 'Marginally' ELSE 'Significant' END AS sig FROM events""",
)
def fn_sign_label(p):
    v = F.col("value")
    return p.table("events").select(
        "event_id", text.sign_label(v - 50).alias("sign"), text.sig_label(F.when(v <= 90, v / 100)).alias("sig")
    )


@query(
    "fn_log_scale",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN 0 ELSE log10(abs(l_discount)) + 2 END AS scaled FROM lineitem",
    "scaled",
)
def fn_log_scale(p):
    return p.table("lineitem").select("l_orderkey", "l_linenumber", units.rose_scale("l_discount").alias("scaled"))


@query(
    "fn_euclid",
    """SELECT site_number, sqrt((lon - cx) ** 2 + (lat - cy) ** 2) AS distance FROM site JOIN (
      SELECT cluster, avg(lon) AS cx, avg(lat) AS cy FROM site GROUP BY 1) USING (cluster)""",
    "distance",
)
def fn_euclid(p):
    centre = p.site.groupBy("cluster").agg(F.avg("lon").alias("cx"), F.avg("lat").alias("cy"))
    return p.site.join(centre, "cluster").select("site_number", units.distance("lon", "lat", "cx", "cy").alias("distance"))


@query(
    "fn_format",
    """SELECT c_custkey, CAST(printf('%.1e', c_acctbal * CAST(0.028316846592 AS DOUBLE)) AS DOUBLE) AS two_figures, printf('%.2e', c_acctbal * CAST(0.028316846592 AS DOUBLE)) AS scientific,
      CASE WHEN c_acctbal / 70000 < CAST(0.001 AS DOUBLE) THEN 'p<0.001' ELSE 'p=' || printf('%.3f', c_acctbal / 70000) END AS p_text
      FROM customer""",
    "two_figures",
)
def fn_format(p):
    v = F.col("c_acctbal") * 0.028316846592
    return p.table("customer").select(
        "c_custkey",
        text.sigfig(v, 2).alias("two_figures"),
        text.sci(v, 2).alias("scientific"),
        text.p_label(F.col("c_acctbal") / 70000).alias("p_text"),
    )


@query("udf_label", "SELECT s_suppkey, printf('%.3e', s_acctbal * CAST(0.028316846592 AS DOUBLE)) AS label FROM supplier")
def udf_label(p):
    return p.table("supplier").select("s_suppkey", text.sci(F.col("s_acctbal") * 0.028316846592, 3).alias("label"))


@query(
    "udf_model_stat",
    """SELECT cluster, f, CASE WHEN n > 3 THEN pow(1 + f / ((n - 3) / 2.0::DOUBLE), -(n - 3) / 2.0::DOUBLE) END AS p FROM (
      SELECT cluster, count(*) AS n, regr_r2(z_log_runoff, z_precip) * count(*) / 2 AS f FROM region_month GROUP BY 1)""",
    "f p",
)
def udf_model_stat(p):
    """F tail with two numerator degrees of freedom, which has a closed form."""
    stats = p.region_month.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), (F.regr_r2("z_log_runoff", "z_precip") * F.count(F.lit(1)) / 2).alias("_h")
    )
    # (1 + 2 f / df2) ** (-df2 / 2) with f = _h
    return stats.select("cluster", F.col("_h").alias("f"), dist.f_pvalue("_h", F.lit(2.0), (F.col("n") - 3).cast("double")).alias("p"))
