"""Null rules, gaps, edges and round trips of the panel operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hydropanel import session, sources
from hydropanel.functions import calendar
from hydropanel.operators import aggregates, catchment, joins, reshape, rows, seasonal, windows


def test_prior_year_with_gap(spark):
    data = [("a", 2000, 1.0), ("a", 2001, 2.0), ("a", 2003, 3.0), ("a", 2004, None), ("a", 2005, 5.0)]
    df = spark.createDataFrame(data, "s string, y int, v double")
    inner = joins.with_prior(df, ["s"], "y", {"v": "p"})
    assert {(r.y, r.p) for r in inner.collect()} == {(2001, 1.0), (2004, 3.0), (2005, None)}
    left = joins.with_prior(df, ["s"], "y", {"v": "p"}, how="left")
    assert left.count() == 5
    assert {(r.y, r.p) for r in joins.with_prior(df, ["s"], "y", {"v": "p"}, k=2).collect()} == {(2003, 2.0), (2005, 3.0)}


def test_centered_mean_edges_and_nulls(spark):
    full = spark.createDataFrame([("a", t, float(t)) for t in range(1, 8)], "s string, t int, v double")
    got = {r.t: r.m for r in windows.centered_mean(full, ["s"], ["t"], {"v": "m"}).collect()}
    assert got == {1: None, 2: None, 3: 3.0, 4: 4.0, 5: 5.0, 6: None, 7: None}
    holed = full.withColumn("v", F.when(F.col("t") != 4, F.col("v")))
    assert all(r.m is None for r in windows.centered_mean(holed, ["s"], ["t"], {"v": "m"}).collect())


def test_record_span(spark):
    long_gap = [("bad", y) for y in [*range(1975, 1991), *range(1995, 2022)]]
    short_gap = [("good", y) for y in [*range(1975, 1991), *range(1993, 2022)]]
    late = [("late", y) for y in range(1985, 2022)]
    df = spark.createDataFrame(long_gap + short_gap + late, "site_number string, year int")
    assert [r.site_number for r in aggregates.record_span(df).collect()] == ["good"]


@pytest.mark.parametrize("period", [None, "y"])
def test_zscore(spark, period):
    data = [("a", y, float(v)) for y, v in enumerate([1, 2, 4, 8])] + [("one", 0, 5.0), ("flat", 0, 3.0), ("flat", 1, 3.0)]
    df = spark.createDataFrame(data, "s string, y int, v double")
    z = windows.zscore(df, ["s"], {"v": "z"}, period=period)
    stats = z.groupBy("s").agg(F.avg("z").alias("m"), F.stddev_samp("z").alias("d")).collect()
    by = {r.s: (r.m, r.d) for r in stats}
    assert by["a"] == (pytest.approx(0, abs=1e-12), pytest.approx(1))
    assert by["one"] == (None, None) and by["flat"] == (None, None)
    back = windows.unzscore(z, ["s"], {"z": "b"}, "v", period=period).filter("s = 'a'")
    assert all(r.b == pytest.approx(r.v) for r in back.collect())


def test_both_plans_of_group_statistics_agree(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), F.col("id").alias("t"), F.rand(3).alias("v"))
    df = sources.checkpoint_table(df)
    a = windows.zscore(df, ["g"], {"v": "z"}).select("t", F.round("z", 9).alias("z"))
    b = windows.zscore(df, ["g"], {"v": "z"}, period="t").select("t", F.round("z", 9).alias("z"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("period", [None, "t"])
def test_rows_without_a_key_are_a_group(spark, period):
    df = spark.createDataFrame([("a", 1, 1.0), (None, 1, 2.0), (None, 2, 4.0)], "s string, t int, v double")
    got = windows.add_group_agg(df, ["s"], {"m": F.avg("v")}, period)
    assert got.columns == ["s", "t", "v", "m"]
    assert {(r.s, r.v, r.m) for r in got.collect()} == {("a", 1.0, 1.0), (None, 2.0, 3.0), (None, 4.0, 3.0)}


def test_a_hot_key_is_combined_before_the_shuffle(spark):
    """Nine rows in ten belong to one station: the shuffle sees one partial row per task and key."""
    df = spark.range(0, 100_000, 1, 8).select(
        F.when(F.col("id") % 10 < 9, F.lit("hot")).otherwise((F.col("id") % 7).cast("string")).alias("s"), F.rand(1).alias("v")
    )
    df = sources.checkpoint_table(df)
    plan = windows.zscore(df, ["s"], {"v": "z"})._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_stddev_samp" in plan
    z = windows.zscore(df, ["s"], {"v": "z"}).groupBy("s").agg(F.avg("z").alias("m"), F.count("z").alias("n"))
    got = {r.s: r for r in z.collect()}
    assert got["hot"].n == 90_000 and got["hot"].m == pytest.approx(0, abs=1e-9)


def test_null_propagation(spark):
    df = spark.createDataFrame([("DJF", 1.0), ("DJF", None), ("JJA", 2.0)], "s string, p double")
    assert {(r.s, r.p) for r in aggregates.group_sum(df, ["s"], ["p"]).collect()} == {("DJF", None), ("JJA", 2.0)}
    assert {(r.s, r.p) for r in aggregates.group_mean(df, ["s"], ["p"]).collect()} == {("DJF", 1.0), ("JJA", 2.0)}
    sd = aggregates.group_mean_sd(df, ["s"], {"p": ("m", "d")})
    assert all(r.d is None for r in sd.collect())


def test_first_per_limits_before_the_shuffle(spark):
    df = spark.range(10_000).select((F.col("id") % 2).alias("k"), F.col("id").alias("o"))
    first = aggregates.first_per(df, ["k"], ["o"])
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert {r.o for r in first.collect()} == {0, 1}


def test_two_level_and_residual(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 3.0), ("b", 1, 8.0)], "s string, c int, v double")
    got = {r.s: (r.site_mean, r.region_mean) for r in aggregates.two_level_mean(df, "s", "c", "v").collect()}
    assert got == {"a": (2.0, 4.0), "b": (8.0, 4.0)}
    assert {r.v_residual for r in windows.residual(df, ["c"], "v").collect()} == {-3.0, -1.0, 4.0}


def test_wide_long_identity(spark):
    data = [(s, m, float(s * 100 + m)) for s in (1, 2) for m in range(1, 13) if (s, m) != (2, 5)]
    df = spark.createDataFrame(data, "s int, month int, v double")
    for values, prefix in ((range(1, 13), {"v": "Pcpt"}), (range(1, 21), {"v": "Pcpt"})):  # aggregate and pivot
        names = [f"{m:02d}" for m in values]
        wide = reshape.to_wide(df, ["s"], "month", prefix, values, names)
        long = reshape.to_long_month(wide, ["s"], [f"Pcpt{n}" for n in names], r"Pcpt(\d+)")
        assert {(r.s, r.month, r.value) for r in long.filter("value is not null").collect()} == set(data)
        assert long.count() == 2 * len(names)


def test_rename_and_conditional_update(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None)], "a int, b double")
    assert rows.rename(df, {"b": "c", "zzz": "q"}).columns == ["a", "c"]
    out = rows.update_where(df, F.col("b").isNull(), {"b": F.lit(0.0), "f": F.lit("was null")})
    assert sorted(map(tuple, out.collect())) == [(1, 2.0, None), (2, 0.0, "was null")]
    assert rows.cols_at(df, [2]).columns == ["b"]


def test_in_year_reaches_the_scan(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(y, m, 1),) for y in (1996, 1997) for m in (1, 12)], "d date")
    sources.write_table(df, str(tmp_path / "t"))
    out = rows.in_year(spark.read.parquet(str(tmp_path / "t")), "d", 1997)
    assert out.count() == 2
    assert "GreaterThanOrEqual(d,1997-01-01)" in out._jdf.queryExecution().executedPlan().toString()


def _months(spark):
    """Three years of one station, precipitation equal to the month number, flow 1."""
    data = [("s", 1, y, m, 1.0, float(m), 280.0, 1.0) for y in (2000, 2001, 2002) for m in range(1, 13)]
    df = spark.createDataFrame(
        data, "site_number string, cluster int, cal_year int, month int, mean_q double, precip_m double, temp_k double, area double"
    )
    return df.withColumns(
        {"season": calendar.season("month"), "year": calendar.water_year_of("cal_year", "month")}
    )


def test_season_panel(spark):
    months = _months(spark)
    got = {(r.year, r.season): r for r in seasonal.season_panel(months).collect()}
    djf = got[(2002, "DJF")]
    assert djf.month == 1  # the lowest month of the season
    assert 10**djf.winter_precip == pytest.approx(12 + 1 + 2)
    assert 10**djf.fall_precip == pytest.approx(9 + 10 + 11)
    assert 10**djf.season_precip == pytest.approx(15)
    # autumn of water year 2002: the September row, whose season is the autumn of 2002
    assert got[(2002, "SON")].month == 9 and got[(2002, "SON")].cal_year == 2002
    # 2000 has no autumn before it, 2001 no complete year before it
    assert {y for y, _ in got} == {2002}


def test_season_panel_blend(spark):
    months = _months(spark).withColumn("precip_m", F.col("precip_m") * (F.col("cal_year") - 1999))
    plain = {r.year: 10**r.fall_precip for r in seasonal.season_panel(months).collect()}
    blend = {r.year: 10**r.fall_precip for r in seasonal.season_panel(months, blend=True).collect()}
    assert plain[2002] == pytest.approx(30 * 2)  # autumn of 2001
    assert blend[2002] == pytest.approx((2 * 60 + 90) / 3)  # October, November of 2001 and September of 2002


def test_catchment_blocks_agree(spark):
    data = [("c", dt.date(2001, m, d), 2.0 + d, 0.01 * m, float(m), 5.0) for m in range(1, 13) for d in (1, 2)]
    df = spark.createDataFrame(data, "k string, date date, mean_q double, precip_m double, well_m double, peak_q double")
    wide = catchment.season_blocks(df, ["k"], F.lit(100.0))
    for name in ("winter", "spring", "summer", "fall"):
        months, seconds = catchment.BLOCKS[name]
        one = catchment.season_block(df, ["k"], F.lit(100.0), months, seconds, name).first()
        both = wide.filter(F.col("water_year") == one.water_year).first()
        assert both[f"{name}_re"] == pytest.approx(one[f"{name}_re"])


def test_missing_days_are_left_out_of_blocks_only(spark):
    data = [("c", dt.date(2001, 1, 1), 1.0, 1.0, 1.0, 1.0, -3.0), ("c", dt.date(2001, 1, 2), 1.0, None, 1.0, 1.0, -1.0)]
    df = spark.createDataFrame(data, "k string, date date, mean_q double, precip_m double, well_m double, peak_q double, temp_c double")
    block = catchment.season_block(df, ["k"], F.lit(1.0), (1,), 1.0, "w").first()
    assert block.w_precip == 1.0
    assert catchment.season_re(df, ["k"], F.lit(1.0)).first().season_precip is None
    cold = catchment.cold_months(df, ["k"], F.lit(1.0)).first()
    assert cold.month_temp == -2.0 and cold.precip_sum is None
    assert catchment.cold_days(df, ["k"]).count() == 2


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("01013500", 1.5, None), ("0002", None, "x")], "site_number string, v double, t string")
    path = str(tmp_path / "a.csv")
    sources.write_csv(df, path)
    back = sources.read_table(spark, path, "site_number STRING, v DOUBLE, t STRING")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        sources.read_table(spark, path)
    kept = sources.checkpoint_table(df)
    assert kept.schema == df.schema and sorted(map(tuple, kept.collect())) == sorted(map(tuple, df.collect()))
    rings = spark.createDataFrame([("1", "A", [(0.0, 1.0)])], "identifier string, name string, ring array<struct<lon:double,lat:double>>")
    sources.write_table(rings, str(tmp_path / "p1"))
    sources.write_table(rings.withColumnsRenamed({"identifier": "StationNum"}), str(tmp_path / "p2"))
    both = sources.polygons(spark, [str(tmp_path / "p1"), str(tmp_path / "p2")], [{}, {"StationNum": "identifier"}])
    assert both.count() == 2


def test_shared_folder_is_the_named_one(spark):
    assert session.fresh_path(spark, "a") != session.fresh_path(spark, "a")
    named = spark.newSession()
    named.conf.get("spark.checkpoint.dir", None)
    assert session.shared_folder(spark)
