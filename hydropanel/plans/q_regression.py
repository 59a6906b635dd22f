"""Grouped regressions on the region x month panel."""

from pyspark.sql import functions as F

from hydropanel.operators import aggregates, state
from hydropanel.operators import regression as reg
from hydropanel.plans import fit_sql
from hydropanel.plans.panels import FAMILIES, PREDICTORS
from hydropanel.plans.registry import query

Y = "z_log_runoff"
XS = PREDICTORS
_PAIRED = {
    "paired": "SELECT *, z_log_runoff AS y, z_precip AS x FROM region_month WHERE z_log_runoff IS NOT NULL AND z_precip IS NOT NULL"
}
_SIMPLE = """SELECT cluster, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2
  FROM paired GROUP BY cluster"""
_T = "sqrt(r2 * (n - 2) / (1 - r2))"


@query(
    "reg_simple",
    f"SELECT *, 1 - (1 - r2) * (n - 1) / (n - 2) AS adj_r2, {fit_sql.t_p(_T, '(n - 2)')} AS p_value FROM ({_SIMPLE})",
    "slope intercept r2 adj_r2 p_value",
    _PAIRED,
)
def reg_simple(p):
    return reg.simple_fit(p.region_month, ["cluster"], Y, "z_precip")


@query(
    "reg_trend_facet",
    """SELECT site_number, regr_slope(runoff_ratio, year) AS slope, regr_intercept(runoff_ratio, year) AS intercept
      FROM panel_year WHERE runoff_ratio IS NOT NULL GROUP BY site_number HAVING count(DISTINCT year) > 1""",
    "slope intercept",
    digits=4,
)
def reg_trend_facet(p):
    out = reg.trend(p.panel_year, ["site_number"], "runoff_ratio", "year")
    return out.filter(F.col("slope").isNotNull())


@query(
    "reg_trend_shifted",
    """SELECT cluster, regr_slope(mean_q - 2, precip_m) AS slope, regr_intercept(mean_q - 2, precip_m) AS intercept
      FROM panel_year WHERE year <> 1997 GROUP BY cluster""",
    "slope intercept",
)
def reg_trend_shifted(p):
    """Line through a shifted response, one year left out."""
    return reg.trend(p.panel_year.filter(F.col("year") != 1997), ["cluster"], "mean_q", "precip_m", offset=2.0)


@query(
    "reg_corr_label",
    f"""SELECT *, 'R2=' || printf('%.2f', r2) || ', ' || CASE WHEN p_value < 0.001::DOUBLE THEN 'p<0.001' ELSE 'p=' || printf('%.3f', p_value) END AS label
      FROM (SELECT *, {fit_sql.t_p(_T, '(n - 2)')} AS p_value FROM (
      SELECT cluster, corr(y, x) AS r, count(*) AS n, corr(y, x) ** 2 AS r2 FROM paired GROUP BY cluster))""",
    "r r2 p_value",
    _PAIRED,
)
def reg_corr_label(p):
    return reg.corr_label(p.region_month, ["cluster"], Y, "z_precip")


@query("reg_abs_corr", "SELECT cluster, abs(corr(y, x)) AS correlation FROM paired GROUP BY cluster", "correlation", _PAIRED)
def reg_abs_corr(p):
    return reg.abs_corr(p.region_month, ["cluster"], Y, "z_precip")


_FULL = {"moments": fit_sql.moments("region_month", "cluster", Y, XS)} | fit_sql.sweeps(
    "moments", "full_fit", "cluster", (1, 2, 3, 4), 5
)
_FULL["full_terms"] = fit_sql.terms("full_fit", "cluster", (1, 2, 3, 4), XS)
_OLS = "estimate std_error t_value p_value vif r2 adj_r2 f_value f_p_value"


@query("reg_ols", f"SELECT *, {fit_sql.f4_p('f_value', '(n - 5)')} AS f_p_value FROM full_terms", _OLS, _FULL)
def reg_ols(p):
    return reg.ols(p.region_month, ["cluster"], Y, XS).drop("aic")


@query("reg_ols_state", f"SELECT *, {fit_sql.f4_p('f_value', '(n - 5)')} AS f_p_value FROM full_terms", _OLS, _FULL)
def reg_ols_state(p):
    """The same from a stored state of which one year was corrected."""
    stats = state.merged(p.corrected_state(["cluster"], [Y, *XS]), ["cluster"])
    return reg.ols_of(stats, ["cluster"], Y, XS).drop("aic")


_INTER_XS = ["z_precip", "z_off_precip", "z_temp", "z_precip_x_z_temp"]
_INTER = {
    "crossed": "SELECT *, z_precip * z_temp AS z_precip_x_z_temp FROM region_month",
    "moments": fit_sql.moments("crossed", "cluster", Y, _INTER_XS),
} | fit_sql.sweeps("moments", "full_fit", "cluster", (1, 2, 3, 4), 5)
_INTER["full_terms"] = fit_sql.terms("full_fit", "cluster", (1, 2, 3, 4), _INTER_XS)


@query("reg_interaction", "SELECT cluster, term, estimate, std_error, p_value FROM full_terms", "estimate std_error p_value", _INTER)
def reg_interaction(p):
    out = reg.ols(p.region_month, ["cluster"], Y, ["z_precip", "z_off_precip", "z_temp"], [("z_precip", "z_temp")])
    return out.select("cluster", "term", "estimate", "std_error", "p_value")


@query(
    "reg_f_pvalue",
    f"SELECT DISTINCT cluster, n, adj_r2, {fit_sql.f4_p('f_value', '(n - 5)')} AS p_value FROM full_terms",
    "adj_r2 p_value",
    _FULL,
)
def reg_f_pvalue(p):
    out = reg.ols(p.region_month, ["cluster"], Y, XS).filter(F.col("term") == "intercept")
    return out.select("cluster", "n", "adj_r2", F.col("f_p_value").alias("p_value"))


@query("reg_vif", "SELECT cluster, term, vif FROM full_terms WHERE vif IS NOT NULL", "vif", _FULL)
def reg_vif(p):
    return reg.vif(p.region_month, ["cluster"], Y, XS)


@query(
    "top_least_sig",
    "SELECT cluster, arg_max(term, p_value) AS term, max(p_value) AS p_value FROM full_terms WHERE term <> 'intercept' GROUP BY cluster",
    "p_value",
    _FULL,
)
def top_least_sig(p):
    return reg.least_significant(reg.ols(p.region_month, ["cluster"], Y, XS), ["cluster"])


_SUBSETS = fit_sql.all_subsets("region_month", "cluster", Y)
_BACK = _SUBSETS | fit_sql.backward_path("cluster")
_WIDE = fit_sql.wide_columns()


@query("reg_backward", f"SELECT cluster, n, {', '.join(_WIDE)} FROM chosen", _WIDE, _BACK)
def reg_backward(p):
    return reg.backward(p.region_month, ["cluster"], Y, XS)


@query(
    "reg_summary",
    f"SELECT cluster, n, {', '.join(_WIDE)}, correlation FROM chosen JOIN (SELECT cluster, abs(corr(y, x)) AS correlation FROM paired GROUP BY cluster) USING (cluster)",
    [*_WIDE, "correlation"],
    _BACK | _PAIRED,
)
def reg_summary(p):
    months = p.stage("region_month")
    models = reg.backward(months, ["cluster"], Y, XS)
    return reg.model_summary(models, reg.abs_corr(months, ["cluster"], Y, "z_precip"), ["cluster"])


_STEP = _SUBSETS | fit_sql.aic_path("cluster")


@query(
    "reg_step_aic",
    "SELECT cluster, term, estimate, adj_r2, aic FROM (SELECT cluster, adj_r2, aic, unnest(['intercept', "
    + ", ".join(f"'{x}'" for x in XS)
    + "]) AS term, unnest([intercept, "
    + ", ".join(f"{x}_coeff" for x in XS)
    + "]) AS estimate FROM fits JOIN stepped USING (cluster, mask)) WHERE estimate IS NOT NULL",
    "estimate adj_r2 aic",
    _STEP,
)
def reg_step_aic(p):
    return reg.step_aic(p.region_month, ["cluster"], Y, XS).select("cluster", "term", "estimate", "adj_r2", "aic")


# ------------------------------------------------------------------ attribution

_PARTS = _BACK | {
    "retained": "SELECT cluster, mask AS rmask FROM chosen",
    "factors": """SELECT r.cluster, CASE WHEN r.rmask & 3 > 0 THEN a.intercept END AS precip_intercept,
      CASE WHEN r.rmask & 12 > 0 THEN b.intercept END AS temp_intercept,
      a.z_precip_coeff AS z_precip, a.z_off_precip_coeff AS z_off_precip, b.z_temp_coeff AS z_temp, b.z_off_temp_coeff AS z_off_temp
      FROM retained r JOIN fits a ON a.cluster = r.cluster AND a.mask = r.rmask & 3
      JOIN fits b ON b.cluster = r.cluster AND b.mask = r.rmask & 12""",
    "predicted": """SELECT m.cluster, m.t,
      coalesce(precip_intercept, 0) + m.z_precip * coalesce(f.z_precip, 0) + m.z_off_precip * coalesce(f.z_off_precip, 0) AS precip_model,
      coalesce(temp_intercept, 0) + m.z_temp * coalesce(f.z_temp, 0) + m.z_off_temp * coalesce(f.z_off_temp, 0) AS temp_model
      FROM region_month m JOIN factors f ON m.cluster = f.cluster""",
    "modelled": "SELECT *, precip_model + temp_model AS full_model FROM predicted",
}


def _factors(p):
    months = p.stage("region_month")
    left = reg.backward(months, ["cluster"], Y, XS)
    terms = F.array(*[F.when(F.col(f"{x}_coeff").isNotNull(), F.lit(x)) for x in XS])
    kept = left.select("cluster", F.explode(F.array_compact(terms)).alias("term"))
    return reg.partial_models(months, ["cluster"], Y, FAMILIES, kept)


def _modelled(p):
    return reg.predict_parts(p.stage("region_month"), _factors(p), ["cluster"], FAMILIES, ["cluster", "t"])


@query("reg_partial_models", "SELECT * FROM factors", ["precip_intercept", "temp_intercept", *XS], _PARTS)
def reg_partial_models(p):
    return _factors(p)


@query("reg_predict", "SELECT * FROM modelled", "precip_model temp_model full_model", _PARTS)
def reg_predict(p):
    return _modelled(p)


@query(
    "reg_obs_vs_model",
    """SELECT cluster, count(d) AS n, avg(d) AS bias, sqrt(avg(d * d)) AS rmse, regr_r2(full_model, z_log_runoff) AS r2
      FROM (SELECT cluster, full_model, z_log_runoff, full_model - z_log_runoff AS d FROM region_month JOIN modelled USING (cluster, t))
      GROUP BY cluster""",
    "bias rmse r2",
    _PARTS,
)
def reg_obs_vs_model(p):
    return reg.compare(p.stage("region_month"), _modelled(p), ["cluster", "t"], ["cluster"], Y, "full_model")


_SLOPES = """SELECT cluster{extra}, regr_slope(full_model, t) AS slope, coalesce(regr_slope(precip_model, t), 0) AS first_slope,
  coalesce(regr_slope(temp_model, t), 0) AS second_slope FROM modelled{source} GROUP BY cluster{extra}"""


@query(
    "reg_trend_attr",
    f"""SELECT *, first_slope / nullif(abs(first_slope) + abs(second_slope), 0) AS first_share,
      second_slope / nullif(abs(first_slope) + abs(second_slope), 0) AS second_share FROM ({_SLOPES.format(extra='', source='')})""",
    "slope first_slope second_slope first_share second_share",
    _PARTS,
)
def reg_trend_attr(p):
    return reg.trend_attribution(_modelled(p), ["cluster"], "full_model", "precip_model", "temp_model", "t")


_STARTS = [12 * y for y in range(1995, 2001)]
_A = "first_slope / nullif(first_slope + second_slope, 0)"
_B = "second_slope / nullif(first_slope + second_slope, 0)"


@query(
    "reg_trend_starts",
    f"""SELECT *, sign(slope) * ({_A}) / nullif(abs({_A}) + abs({_B}), 0) AS first_share,
      sign(slope) * ({_B}) / nullif(abs({_A}) + abs({_B}), 0) AS second_share FROM ({_SLOPES.format(
          extra=', start_year', source=f', (SELECT CAST(unnest({_STARTS}) AS INTEGER) AS start_year) WHERE t > start_year')})""",
    "slope first_slope second_slope first_share second_share",
    _PARTS,
)
def reg_trend_starts(p):
    """Start months instead of decades."""
    return reg.trend_by_start(_modelled(p), ["cluster"], "full_model", "precip_model", "temp_model", _STARTS, "t")


def _smooth(c: str) -> str:
    w = "(PARTITION BY cluster ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
    return f"CASE WHEN count({c}) OVER {w} = 5 THEN avg({c}) OVER {w} END AS smooth_{c}"


_CONTRIB = _BACK | {
    "station_stats": "SELECT site_number, avg(log_runoff) AS mu, stddev_samp(log_runoff) AS sd FROM z_month GROUP BY site_number",
    "station_models": """SELECT z.cluster, z.t, z_log_runoff * sd + mu AS o, c.intercept * sd + mu AS i,
      (c.intercept + z.z_precip * coalesce(z_precip_coeff, 0) + z.z_off_precip * coalesce(z_off_precip_coeff, 0)
        + z.z_temp * coalesce(z_temp_coeff, 0) + z.z_off_temp * coalesce(z_off_temp_coeff, 0)) * sd + mu AS f,
      (c.intercept + z.z_precip * coalesce(z_precip_coeff, 0) + z.z_off_precip * coalesce(z_off_precip_coeff, 0)) * sd + mu AS pp,
      (c.intercept + z.z_temp * coalesce(z_temp_coeff, 0) + z.z_off_temp * coalesce(z_off_temp_coeff, 0)) * sd + mu AS tt
      FROM z_month z JOIN chosen c ON z.cluster = c.cluster JOIN station_stats s ON s.site_number = z.site_number""",
    "deviations": """SELECT cluster, t, avg(o) - avg(i) AS observed, avg(f) - avg(i) AS deviation, avg(pp) - avg(i) AS precip, avg(tt) - avg(i) AS temp
      FROM station_models GROUP BY cluster, t""",
}
_DEV = ["observed", "deviation", "precip", "temp"]


@query(
    "reg_contrib",
    f"SELECT *, {', '.join(_smooth(c) for c in _DEV)} FROM deviations",
    [*_DEV, *[f"smooth_{c}" for c in _DEV]],
    _CONTRIB,
)
def reg_contrib(p):
    z = p.stage("z_month")
    months = aggregates.region_year(z, ["cluster", "t"], [Y, *XS])
    coefs = reg.backward(months, ["cluster"], Y, XS)
    return reg.contributions(z, coefs, "site_number", "cluster", "t", Y, "log_runoff", FAMILIES)


# ---------------------------------------------------------------- season models

_PRECIP = {"z_fall_precip": "SON", "z_winter_precip": "DJF", "z_spring_precip": "MAM", "z_summer_precip": "JJA"}
_GRID = {
    "season_pairs": "SELECT cluster, season AS season_runoff, season_precip, z_season_runoff AS y, x FROM ("
    + " UNION ALL ".join(
        f"SELECT cluster, season, z_season_runoff, '{s}' AS season_precip, {c} AS x FROM region_season" for c, s in _PRECIP.items()
    )
    + ") WHERE z_season_runoff IS NOT NULL AND x IS NOT NULL",
    "season_r2": """SELECT cluster, season_runoff, season_precip, count(*) AS n, regr_slope(y, x) AS slope, regr_r2(y, x) AS r2
      FROM season_pairs GROUP BY ALL""",
    "season_fits": f"""SELECT cluster, season_runoff, season_precip, n, slope,
      CASE WHEN n > 2 THEN 1 - (1 - r2) * (n - 1) / (n - 2) END AS adj_r2,
      CASE WHEN n > 2 THEN {fit_sql.t_p(_T, '(n - 2)')} END AS p_value FROM season_r2""",
}


def _season_fits(p):
    return reg.season_grid(p.region_season, ["cluster"], "season", "z_season_runoff", _PRECIP)


@query("reg_season_grid", "SELECT * FROM season_fits", "slope adj_r2 p_value", _GRID)
def reg_season_grid(p):
    return _season_fits(p)


_RANK = "CASE {} WHEN 'SON' THEN 1 WHEN 'DJF' THEN 2 WHEN 'MAM' THEN 3 ELSE 4 END"


@query(
    "reg_sig_filter",
    f"SELECT * FROM season_fits WHERE p_value <= 0.5::DOUBLE AND {_RANK.format('season_precip')} <= {_RANK.format('season_runoff')}",
    "slope adj_r2 p_value",
    _GRID,
)
def reg_sig_filter(p):
    """Looser than the usual 0.1, so that the short driver series leave rows."""
    return reg.significant(_season_fits(p), 0.5, causal=True)


@query(
    "reg_season_sig",
    """SELECT cluster, season, pow(10, pm) AS precip_m, pow(10, tm) - CAST(273.15 AS DOUBLE) AS temp_c, slope, adj_r2, p_value,
      CASE WHEN p_value IS NULL THEN 'Insignificant' ELSE 'Significant' END AS significance
      FROM (SELECT cluster, season, avg(season_precip) AS pm, avg(season_temp) AS tm FROM season_values GROUP BY 1, 2)
      LEFT JOIN (SELECT cluster, season_runoff AS season, slope, adj_r2, p_value FROM season_fits
        WHERE season_runoff = season_precip AND p_value < 0.1::DOUBLE) USING (cluster, season)""",
    "precip_m temp_c slope adj_r2 p_value",
    _GRID,
)
def reg_season_sig(p):
    values = p.stage("season_values")
    p.season_values = values
    return reg.season_significance(values, _season_fits(p), "cluster", "season", "season_precip", "season_temp")
