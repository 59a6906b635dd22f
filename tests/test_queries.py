"""Registered queries against their SQL on the smallest driver tables.

A sample of every section by default; all of them with HYDROPANEL_ALL=1.
"""

import collections
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
SAMPLE = [
    "src_checkpoint", "snk_csv", "prj_cond_update", "flt_date_window", "nul_zero", "jn_offset", "jn_spatial",
    "agg_mean_sd", "agg_two_level", "agg_season_panel", "agg_season_panel_blend", "win_zscore", "win_long_series", "rsh_wide_siteyear",
    "fn_norm_share", "reg_corr_label", "reg_ols", "reg_ols_state", "agg_gram_state", "reg_backward", "reg_step_aic", "reg_trend_starts", "reg_contrib", "sp_krige_nugget",
    "reg_season_grid", "sp_zonal_mean", "sp_variogram_fit", "cl_regime", "cl_silhouette", "cl_kmeans", "udf_group_stream", "jn_spatial_parts", "jn_inner_n", "set_bind_list", "ct_season_wide",
]

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def test_every_query_is_callable_and_named_alike():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    own = {q for q in entry.queries() if q != "pipeline" and not q.startswith("op")}
    assert own - set(entry.oracle_sql()) == {"sp_krige", "cl_kmeans_exchange"}


@pytest.mark.parametrize(
    "name, bound",
    [("flt_range", "GreaterThanOrEqual(l_shipdate"), ("flt_ne", "LessThan(l_shipdate"), ("flt_eq_item", "EqualTo(l_suppkey")],
)
def test_filters_reach_the_scan(spark, name, bound):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "lineitem.parquet" in line]
    assert len(scans) == 1 and bound in scans[0].split("PushedFilters")[1]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["cluster", "runoff_mean", "runoff_sd"] and df.count() > 0


@pytest.mark.parametrize("name", [q for q in entry.oracle_sql() if not q.startswith("op")] if os.environ.get("HYDROPANEL_ALL") else SAMPLE)
def test_query_matches_sql(spark, duck, name):
    mine = entry.queries()[name](spark, DATA)
    cols = sorted(mine.columns)
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    want = collections.Counter(tuple(r[i] for i in order) for r in result.fetchall())
    got = collections.Counter(tuple(r) for r in mine.select(*[f"`{c}`" for c in cols]).collect())
    assert got == want
