"""Scans and sinks: every table is written to the shared folder in the domain's layout and scanned back."""

from pyspark.sql import functions as F

from hydropanel import session, sources
from hydropanel.operators import rows
from hydropanel.plans.registry import query


def _written(p, df, name, **options):
    path = session.fresh_path(p.spark, name)
    sources.write_table(df, path, **options)
    return path


SITE_SCHEMA = "site_number STRING, cluster INT, area DOUBLE, lon DOUBLE, lat DOUBLE, elev DOUBLE"


@query("src_csv", "SELECT * FROM site", "lon lat elev")
def src_csv(p):
    path = session.fresh_path(p.spark, "site") + ".csv"
    sources.write_csv(p.site, path)
    return sources.read_table(p.spark, path, SITE_SCHEMA)


@query("src_sheet", "SELECT site_number, area, elev FROM site", "elev")
def src_sheet(p):
    return sources.read_table(p.spark, _written(p, p.site, "sheet")).select("site_number", "area", "elev")


@query("src_checkpoint", "SELECT site_number, cluster, year, mean_q, precip_m, temp_k, runoff_ratio FROM panel_year", "mean_q precip_m temp_k runoff_ratio")
def src_checkpoint(p):
    cols = ["site_number", "cluster", "year", "mean_q", "precip_m", "temp_k", "runoff_ratio"]
    return sources.checkpoint_table(p.panel_year.select(*cols))


@query("src_flow_annual", "SELECT site_number AS site_no, year AS year_nu, mean_q AS mean_va FROM panel_year", "mean_va")
def src_flow_annual(p):
    df = p.panel_year.select(
        F.col("site_number").alias("site_no"), F.col("year").alias("year_nu"), F.col("mean_q").alias("mean_va")
    )
    return sources.annual_flow(p.spark, _written(p, df, "annual"))


@query(
    "src_flow_monthly",
    "SELECT site_number AS site_no, cal_year AS year_nu, month AS month_nu, mean_q AS mean_va FROM panel_month",
    "mean_va",
)
def src_flow_monthly(p):
    df = p.panel_month.select(
        F.col("site_number").alias("site_no"), F.col("cal_year").alias("year_nu"),
        F.col("month").alias("month_nu"), F.col("mean_q").alias("mean_va"),
    )
    return sources.monthly_flow(p.spark, _written(p, df, "monthly"))


@query(
    "src_flow_daily",
    "SELECT 'long' AS agency, site_number, date, mean_q AS value FROM daily WHERE length(site_number) >= 2",
    "value",
)
def src_flow_daily(p):
    agency = F.when(F.length("site_number") >= 2, "long").otherwise("short")
    df = p.daily.select("site_number", "date", F.col("mean_q").alias("value"), agency.alias("agency"))
    return sources.daily_flow(p.spark, _written(p, df, "daily", partition_by=["agency"]), "long")


@query(
    "src_station_meta",
    """SELECT site_number AS STATION_NUMBER, 'Q' AS DATA_TYPE, cluster % 2 = 1 AS REGULATED,
      min(year) AS Year_from, max(year) AS Year_to FROM panel_year GROUP BY site_number, cluster""",
)
def src_station_meta(p):
    df = p.panel_year.groupBy("site_number", "cluster").agg(
        F.min("year").alias("Year_from"), F.max("year").alias("Year_to")
    )
    df = df.select(
        F.col("site_number").alias("STATION_NUMBER"), F.lit("Q").alias("DATA_TYPE"),
        (F.col("cluster") % 2 == 1).alias("REGULATED"), "Year_from", "Year_to",
    )
    return sources.station_meta(p.spark, _written(p, df, "meta"))


@query("src_grid", "SELECT cell_id, lon, lat, time, 'ppt' AS var, value FROM cells", "lon lat value")
def src_grid(p):
    df = p.cells.select("cell_id", "lon", "lat", "time", F.lit("ppt").alias("var"), "value")
    return sources.grid_cells(p.spark, _written(p, df, "grid", partition_by=["var"]), "ppt")


@query(
    "src_polygon",
    """SELECT identifier, name, vertex, lon, lat FROM (
      SELECT identifier, 'W' || identifier AS name, row_number() OVER (PARTITION BY identifier ORDER BY k) - 1 AS vertex, x1 AS lon, y1 AS lat
      FROM (SELECT *, list_position([-1.503, 0.311, 1.607, 0.401, 0.207, -1.307], CAST(round(x1 - lon, 3) AS DECIMAL(4,3))) AS k
        FROM edges JOIN (SELECT site_number AS identifier, lon FROM site) USING (identifier)))""",
    "lon lat",
)
def src_polygon(p):
    """Two agencies with different column names, stacked, one row per vertex."""
    named = p.watersheds.withColumn("name", F.concat(F.lit("W"), "identifier"))
    a, b = rows.split_by_length(named, "identifier", 2)
    b = b.withColumnsRenamed({"identifier": "StationNum", "name": "NameNom"})
    paths = [_written(p, a, "polygon-a"), _written(p, b, "polygon-b")]
    out = sources.polygons(p.spark, paths, [{}, {"StationNum": "identifier", "NameNom": "name"}])
    flat = out.select("identifier", "name", F.posexplode("ring").alias("vertex", "v"))
    return flat.select("identifier", "name", F.col("vertex").cast("long").alias("vertex"), "v.lon", "v.lat")


@query("snk_csv", "SELECT cluster, year, z_log_runoff, z_precip FROM region_year", "z_log_runoff z_precip")
def snk_csv(p):
    path = session.fresh_path(p.spark, "region") + ".csv"
    sources.write_csv(p.region_year.select("cluster", "year", "z_log_runoff", "z_precip"), path)
    return sources.read_table(p.spark, path, "cluster INT, year INT, z_log_runoff DOUBLE, z_precip DOUBLE")


@query("snk_sheet", "SELECT site_number, t, mean_q, off_precip FROM offset_month", "mean_q off_precip")
def snk_sheet(p):
    df = p.offset(p.panel_month, "t").select("site_number", "t", "mean_q", "off_precip")
    return sources.read_table(p.spark, _written(p, df, "offset"))


@query("snk_flat_export", "SELECT site_number, year, mean_q, precip_m FROM panel_year", "mean_q precip_m")
def snk_flat_export(p):
    """Yearly features nested per station, flattened and exported."""
    nested = p.panel_year.groupBy("site_number").agg(
        F.collect_list(F.struct("year", "mean_q", "precip_m")).alias("years")  # bounded by the number of years
    )
    path = session.fresh_path(p.spark, "flat") + ".csv"
    sources.flatten_export(nested, "years", path)
    return sources.read_table(p.spark, path, "site_number STRING, year INT, mean_q DOUBLE, precip_m DOUBLE")


