"""Daily series of single catchments; ``keys`` lets many catchments run at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydropanel.functions import calendar, units
from hydropanel.operators.aggregates import strict
from hydropanel.operators.reshape import to_long
from hydropanel.operators.rows import complete, display_order
from hydropanel.operators.windows import add_group_agg

# Fixed values: (months, seconds) of the season blocks.
BLOCKS = {
    "winter": ((1, 2, 3), 5_097_600.0),
    "spring": ((3, 4, 5), 7_948_800.0),
    "summer": ((6, 7, 8), 7_948_800.0),
    "fall": ((10, 11), 7_948_800.0),
    "september": ((9,), 2_678_400.0),
}

# Fixed value: seconds of the monthly efficiency of a catchment.
SECONDS_MONTH = 2_628_000.0


def season_re(daily: DataFrame, keys, area, seconds: float = 86_400.0 * 90, last_month: int = 8) -> DataFrame:
    """Season mean flow, precipitation sum and runoff efficiency; outliers are NULL.

    Flow is averaged over days with a peak value; a missing precipitation makes the
    season's sum NULL.
    """
    season = calendar.season(F.month("date"))
    flow = F.avg(F.when(F.col("peak_q").isNotNull(), F.col("mean_q")))
    out = daily.groupBy(
        *keys, season.alias("season"), calendar.water_year("date", last_month).alias("water_year")
    ).agg(flow.alias("season_q"), strict(F.sum, "precip_m").alias("season_precip"))
    ratio = units.runoff_ratio("season_q", area, "season_precip", seconds)
    return out.withColumn("season_re", units.null_if_beyond(ratio))


def season_block(daily: DataFrame, keys, area, months, seconds: float, prefix: str) -> DataFrame:
    """Precipitation sum, mean flow, mean well depth and efficiency of a month list per water year.

    Days with any missing value are left out first.
    """
    days = complete(daily.filter(F.month("date").isin(*months)))
    out = days.groupBy(*keys, calendar.water_year("date").alias("water_year")).agg(
        F.sum("precip_m").alias(f"{prefix}_precip"),
        F.avg("mean_q").alias(f"{prefix}_flow"),
        F.avg("well_m").alias(f"{prefix}_well"),
    )
    ratio = units.runoff_ratio(f"{prefix}_flow", area, f"{prefix}_precip", seconds)
    return out.withColumn(f"{prefix}_re", ratio)


def season_blocks(daily: DataFrame, keys, area, names=("winter", "spring", "summer", "fall")) -> DataFrame:
    """All blocks side by side from one pass over the daily rows."""
    days = complete(daily)
    month = F.month("date")
    aggs: list[Column] = []
    for name in names:
        inside = month.isin(*BLOCKS[name][0])
        aggs += [
            F.sum(F.when(inside, F.col("precip_m"))).alias(f"{name}_precip"),
            F.avg(F.when(inside, F.col("mean_q"))).alias(f"{name}_flow"),
            F.avg(F.when(inside, F.col("well_m"))).alias(f"{name}_well"),
        ]
    out = days.groupBy(*keys, calendar.water_year("date").alias("water_year")).agg(*aggs)
    return out.withColumns(
        {f"{n}_re": units.runoff_ratio(f"{n}_flow", area, f"{n}_precip", BLOCKS[n][1]) for n in names}
    )


def season_wide(blocks: list[DataFrame], keys) -> DataFrame:
    """Separately built blocks joined on the water year, with summer over winter efficiency."""
    wide = reduce(lambda a, b: a.join(b, [*keys, "water_year"]), blocks)
    return wide.withColumn("norm_re", F.try_divide("summer_re", "winter_re"))


def cold_days(daily: DataFrame, keys) -> DataFrame:
    """Daily rows of months whose mean temperature is at or below freezing.

    One row per catchment and day, so a group is at most the days of a month.
    """
    days = daily.withColumns({"month": F.month("date"), "water_year": calendar.water_year("date")})
    out = add_group_agg(days, [*keys, "month", "water_year"], {"_t": F.avg("temp_c"), "_n": F.count("temp_c"), "_all": F.count(F.lit(1))}, period="date")
    mean = F.when(F.col("_n") == F.col("_all"), F.col("_t"))
    return out.withColumn("month_temp", mean).drop("_t", "_n", "_all").filter(F.col("month_temp") <= 0)


def cold_months(daily: DataFrame, keys, area, seconds: float = SECONDS_MONTH) -> DataFrame:
    """Flow, precipitation, well depth and efficiency of cold months.

    The temperature test is on the same group as the sums, so one aggregate does both.
    """
    out = daily.groupBy(
        *keys, F.month("date").alias("month"), calendar.water_year("date").alias("water_year")
    ).agg(
        strict(F.avg, "temp_c").alias("month_temp"),
        strict(F.avg, "well_m").alias("month_well"),
        strict(F.sum, "precip_m").alias("precip_sum"),
        strict(F.avg, "mean_q").alias("month_flow"),
    )
    return out.filter(F.col("month_temp") <= 0).withColumn(
        "re", units.runoff_ratio("month_flow", area, "precip_sum", seconds)
    )


def groundwater_long(df: DataFrame, ids, depth_cols: dict[str, int], ref: float = 5.0) -> DataFrame:
    """Seasonal groundwater depths to rows of elevation, with a display order."""
    long = to_long(df, ids, list(depth_cols), "variable", "value")
    return display_order(long.withColumn("value", units.depth_to_elev("value", ref)), "variable", depth_cols)
