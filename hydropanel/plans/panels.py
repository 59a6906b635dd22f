"""Domain tables derived from the driver tables.

A supplier is a station, its region a hydro-region, a line item a measurement: price
stands for discharge, quantity for precipitation, discount for temperature and tax
for well depth.  Customers are points and grid cells, embeddings are feature vectors.
Every table is built with the package's own operators and reads only the columns it
needs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydropanel import session
from hydropanel.functions import calendar, units
from hydropanel.functions.geo import to_albers
from hydropanel.operators import aggregates, joins, rows, seasonal, state, windows
from hydropanel.sources import checkpoint_table

# Vertices of a station's watershed ring around its coordinates, in degrees.
RING_OFFSETS = ((-1.503, -1.207), (0.311, -1.803), (1.607, 0.103), (0.401, 0.507), (0.207, 1.701), (-1.307, 1.103))
BASIN_OFFSETS = (
    RING_OFFSETS,
    tuple((0.4 * dx, 0.4 * dy) for dx, dy in RING_OFFSETS),
    tuple((3.7 + 0.5 * dx, 0.5 * dy) for dx, dy in RING_OFFSETS),
)

Z_COLS = {
    "log_q": "z_q",
    "log_runoff": "z_log_runoff",
    "runoff_ratio": "z_runoff",
    "log_precip": "z_precip",
    "log_off_precip": "z_off_precip",
    "log_temp": "z_temp",
    "log_off_temp": "z_off_temp",
}
PREDICTORS = ["z_precip", "z_off_precip", "z_temp", "z_off_temp"]
FAMILIES = {"precip": ["z_precip", "z_off_precip"], "temp": ["z_temp", "z_off_temp"]}


class Panel:
    """Lazy tables over one data directory; ``keep`` is a filter on the raw measurements."""

    def __init__(self, spark: SparkSession, sf_dir: str, keep: Callable[[DataFrame], DataFrame] | None = None):
        self.spark = session.prepare(spark)
        self.dir = sf_dir.rstrip("/")
        self.keep = keep
        self.staged: dict[str, DataFrame] = {}

    def stage(self, name: str) -> DataFrame:
        """A domain table written once, for queries that read it more than once."""
        if name not in self.staged:
            self.staged[name] = checkpoint_table(getattr(self, name))
        return self.staged[name]

    def only(self, keep: Callable[[DataFrame], DataFrame]) -> Panel:
        """The same tables over a part of the raw measurements; plain comparisons of raw columns reach the scan."""
        return Panel(self.spark, self.dir, keep)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def site(self) -> DataFrame:
        s, n = self.table("supplier"), self.table("nation").select("n_nationkey", "n_regionkey")
        key = F.col("s_suppkey")
        return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
            key.cast("string").alias("site_number"),
            F.col("n_regionkey").cast("int").alias("cluster"),
            units.convert(F.lit(1000.0) + F.abs("s_acctbal"), "km2", "m2").alias("area"),
            (F.lit(-142.0) + (key * 7919 % 9200) / 100).alias("lon"),
            (F.lit(24.5) + (key * 104729 % 4550) / 100).alias("lat"),
            (F.col("s_acctbal") / 10).alias("elev"),
        )

    @cached_property
    def obs(self) -> DataFrame:
        """Single measurements."""
        facts = self.table("lineitem")
        return (self.keep(facts) if self.keep else facts).select(
            F.col("l_suppkey").cast("string").alias("site_number"),
            F.to_date("l_shipdate").alias("date"),
            F.col("l_extendedprice").alias("q_cfs"),
            F.col("l_quantity").alias("precip"),
            F.col("l_discount").alias("discount"),
            F.col("l_tax").alias("tax"),
        )

    @cached_property
    def daily(self) -> DataFrame:
        """One row per station and day, metric units."""
        day = self.obs.groupBy("site_number", "date").agg(
            F.avg("q_cfs").alias("q"), F.max("q_cfs").alias("peak"), F.sum("precip").alias("p"),
            F.avg("tax").alias("tax"), F.avg("discount").alias("discount"),
        )
        return day.select(
            "site_number",
            "date",
            units.convert("q", "ft3/s", "m3/s").alias("mean_q"),
            units.convert("peak", "ft3/s", "m3/s").alias("peak_q"),
            units.convert("p", "in", "m").alias("precip_m"),
            units.convert(1 + 100 * F.col("tax"), "ft", "m").alias("well_m"),
            (100 * F.col("discount") - 5.0037).alias("temp_c"),
        )

    def _climate(self, *keys) -> DataFrame:
        agg = self.obs.groupBy("site_number", *keys).agg(
            units.convert(F.avg("q_cfs"), "ft3/s", "m3/s").alias("mean_q"),
            units.convert(F.sum("precip"), "in", "m").alias("precip_m"),
            units.convert(100 * F.avg("discount"), "C", "K").alias("temp_k"),
        )
        return joins.attach(agg, self.site, "site_number", ["cluster", "area", "lon", "lat"])

    @cached_property
    def panel_year(self) -> DataFrame:
        """Station x water year with runoff efficiency."""
        return self._climate(calendar.water_year("date").alias("year")).withColumn(
            "runoff_ratio", units.runoff_ratio("mean_q", "area", "precip_m")
        )

    @cached_property
    def panel_month(self) -> DataFrame:
        """Station x calendar month; ``t`` counts months."""
        y, m = F.year("date"), F.month("date")
        out = self._climate(y.alias("cal_year"), m.alias("month"))
        return out.withColumns(
            {
                "year": calendar.water_year_of("cal_year", "month"),
                "season": calendar.season("month"),
                "t": F.col("cal_year") * 12 + F.col("month"),
                "runoff_ratio": units.runoff_ratio("mean_q", "area", "precip_m", units.SECONDS_MONTH),
            }
        )

    def offset(self, panel: DataFrame, time: str) -> DataFrame:
        """Panel with the values of the period before."""
        base = rows.positive(panel, ["mean_q"]).select(
            "site_number", "cluster", time, "mean_q", "precip_m", "temp_k", "runoff_ratio"
        )
        return joins.with_prior(base, ["site_number"], time, {"precip_m": "off_precip", "temp_k": "off_temp"})

    def scores(self, panel: DataFrame, time: str) -> DataFrame:
        """Standard scores of the logarithms per station."""
        logs = {
            "log_q": "mean_q", "log_runoff": "runoff_ratio", "log_precip": "precip_m",
            "log_off_precip": "off_precip", "log_temp": "temp_k", "log_off_temp": "off_temp",
        }
        out = self.offset(panel, time).withColumns({n: units.log10_safe(c) for n, c in logs.items()})
        return windows.zscore(out, ["site_number"], Z_COLS, period=time)

    @cached_property
    def z_year(self) -> DataFrame:
        return self.scores(self.panel_year, "year")

    @cached_property
    def z_month(self) -> DataFrame:
        return self.scores(self.panel_month, "t")

    @cached_property
    def region_year(self) -> DataFrame:
        return aggregates.region_year(self.z_year, ["cluster", "year"], list(Z_COLS.values()))

    @cached_property
    def region_month(self) -> DataFrame:
        return aggregates.region_year(self.z_month, ["cluster", "t"], list(Z_COLS.values()))

    def corrected_state(self, group, cols) -> DataFrame:
        """A stored state of the region panel by calendar year: first with wrong values in the last year, which is then replaced."""
        months = self.stage("region_month").withColumn("cal_year", F.expr("cast((t - 1) div 12 as int)"))
        last = months.agg(F.max("cal_year")).first()[0]
        wrong = months.withColumns({c: F.when(F.col("cal_year") == last, 2 * F.col(c) + 1).otherwise(F.col(c)) for c in cols})
        path = session.fresh_path(self.spark, "region-state")
        state.update(path, wrong, group, "cal_year", cols)
        state.update(path, months, group, "cal_year", cols, [last])
        kinds = ", ".join(f"`{c}` {months.schema[c].dataType.simpleString()}" for c in group)
        return state.read(self.spark, path, kinds, "cal_year", "int")

    @cached_property
    def season_values(self) -> DataFrame:
        return seasonal.season_panel(self.panel_month)

    @cached_property
    def z_season(self) -> DataFrame:
        cols = {c: f"z_{c}" for c in ("season_q", "season_runoff", *seasonal.SEASON_PRECIP.values(), "prior_summer_precip")}
        return windows.zscore(self.season_values, ["site_number", "season"], cols, period="year")

    @cached_property
    def region_season(self) -> DataFrame:
        sy = calendar.season_year("season", "cal_year", "year")
        cols = [f"z_{c}" for c in ("season_q", "season_runoff", *seasonal.SEASON_PRECIP.values(), "prior_summer_precip")]
        return aggregates.region_year(self.z_season.withColumn("season_year", sy), ["cluster", "season", "season_year"], cols)

    @cached_property
    def points(self) -> DataFrame:
        """Customers as points, in degrees and in metres."""
        key = F.col("c_custkey")
        pts = self.table("customer").select(
            key.alias("point_id"),
            (F.lit(-142.0) + (key * 7919 % 9200) / 100).alias("lon"),
            (F.lit(24.5) + (key * 104729 % 4550) / 100).alias("lat"),
            F.col("c_acctbal").alias("value"),
        )
        x, y = to_albers("lon", "lat")
        return pts.withColumns({"x": x, "y": y})

    @cached_property
    def values(self) -> DataFrame:
        """Values of grid cells (customers) per month, from their orders."""
        month = F.trunc("o_orderdate", "month")
        return self.table("orders").groupBy(F.col("o_custkey").alias("cell_id"), month.alias("time")).agg(
            units.convert(F.avg("o_totalprice"), "ft3/s", "m3/s").alias("value")
        )

    @cached_property
    def cells(self) -> DataFrame:
        """The same values with the coordinates of their cells."""
        at = self.points.select(F.col("point_id").alias("cell_id"), "lon", "lat")
        return self.values.join(at, "cell_id")

    @cached_property
    def watersheds(self) -> DataFrame:
        """A ring around every station."""
        vertex = [
            F.struct((F.col("lon") + dx).alias("lon"), (F.col("lat") + dy).alias("lat")) for dx, dy in RING_OFFSETS
        ]
        return self.site.select(F.col("site_number").alias("identifier"), F.array(*vertex).alias("ring"))

    @cached_property
    def basins(self) -> DataFrame:
        """Polygons of three rings around every station: an outline, a hole in it and a part beside it."""
        rings = [
            F.array(*[F.struct((F.col("lon") + dx).alias("lon"), (F.col("lat") + dy).alias("lat")) for dx, dy in ring])
            for ring in BASIN_OFFSETS
        ]
        return self.site.select(F.col("site_number").alias("identifier"), F.array(*rings).alias("ring"))

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(
            "vec_id", F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("cluster")
        )
