"""Grouped regressions.

One-predictor fits are the built-in ``regr_*`` aggregates.  For several
predictors one pass reduces the rows of a group to one small triangle (``factors``),
and a small solve runs once per group on that single row, however many models are
taken from it. The triangle keeps nearly collinear predictors apart.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from hydropanel.functions import dist, units
from hydropanel.functions.calendar import as_col
from hydropanel.functions.text import p_label
from hydropanel.operators.aggregates import group_mean
from hydropanel.operators.factors import factors, triangle
from hydropanel.operators.joins import apply_params, bind_by_key
from hydropanel.operators.rows import causal_pairs
from hydropanel.operators.windows import centered_mean, unzscore

# ---------------------------------------------------------------- one predictor


def _pairwise(y, x) -> tuple[Column, Column]:
    """Both sides NULL unless both are present."""
    y, x = as_col(y), as_col(x)
    both = y.isNotNull() & x.isNotNull()
    return F.when(both, y), F.when(both, x)


def _line_p(r2: Column, n: Column) -> Column:
    """p of a one-predictor fit; zero for points exactly on a line, NULL below three points."""
    f = F.when(r2 < 1, F.try_divide(r2 * (n - 2), 1 - r2)).when(r2 >= 1, F.lit(float("inf")))
    return dist.f_pvalue(f, F.lit(1.0), (n - 2).cast("double"))


def simple_fit(df: DataFrame, group, y, x) -> DataFrame:
    """Slope, intercept, R2, adjusted R2, n and p of ``y ~ x``; NULL for a constant x."""
    y, x = _pairwise(y, x)
    fit = df.groupBy(*group).agg(
        F.regr_count(y, x).cast("long").alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    )
    n, r2 = F.col("n"), F.col("r2")
    return fit.withColumns(
        {
            "adj_r2": F.when(n > 2, 1 - (1 - r2) * (n - 1) / F.when(n > 2, n - 2)),
            "p_value": _line_p(r2, n),
        }
    )


def trend(df: DataFrame, facet, y, x="year", offset: float = 0.0) -> DataFrame:
    """Trend line per facet; with ``offset`` the line through a shifted response."""
    y, x = _pairwise(y, x)
    y = y - F.lit(offset) if offset else y
    return df.groupBy(*facet).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")
    )


def corr_label(df: DataFrame, group, y, x, digits: int = 2) -> DataFrame:
    """Pearson R2, p and the text drawn beside a panel."""
    y, x = _pairwise(y, x)
    stats = df.groupBy(*group).agg(F.corr(y, x).alias("r"), F.regr_count(y, x).cast("long").alias("n"))
    r, n = F.col("r"), F.col("n")
    stats = stats.withColumns(
        {
            "r2": r * r,
            "p_value": _line_p(r * r, n),
        }
    )
    return stats.withColumn(
        "label", F.concat_ws(", ", F.format_string(f"R2=%.{digits}f", "r2"), p_label("p_value"))
    )


def abs_corr(df: DataFrame, group, y, x, name: str = "correlation") -> DataFrame:
    """Square root of the R2 of the one-predictor fit."""
    y, x = _pairwise(y, x)
    return df.groupBy(*group).agg(F.abs(F.corr(y, x)).alias(name))


# ------------------------------------------------------------ several predictors

_MODEL = (
    "terms array<string>, estimate array<double>, std_error array<double>, t_value array<double>, "
    "p_value array<double>, vif array<double>, n long, r2 double, adj_r2 double, "
    "f_value double, f_p_value double, aic double"
)


# A predictor whose part that earlier ones do not explain is smaller than this share of it depends on them.
_DEPENDS = 1e-10


def _fit(n: int, r, xs: list[int], names: list[str]) -> dict | None:
    """Least squares of the first column on others, from the triangle ``r`` of [1, names]. Predictors that depend on earlier ones are left
    out of the fit and have NULLs; None when there are too few rows or nothing varies."""
    k = len(xs)
    t = triangle(r[:, [0, *[x + 1 for x in xs], 1]])
    spread = np.sqrt((t[1:] ** 2).sum(axis=0))  # root of each column's sum of squares around its mean
    own = np.abs(np.diag(t))[1 : k + 1]
    fixed = spread[1 : k + 1] <= 1e-13 * np.abs(t[0, 1 : k + 1])
    use = [x for x, o, s, f in zip(xs, own, spread[1 : k + 1], fixed, strict=True) if o > _DEPENDS * s and not f]
    if len(use) < k:
        model = _fit(n, r, use, names)
        if model is None:
            return None
        at = {x: i for i, x in enumerate(model["terms"])}
        terms = ["intercept"] + [names[i] for i in xs]
        for c in ("estimate", "std_error", "t_value", "p_value", "vif"):
            model[c] = [model[c][at[x]] if x in at else None for x in terms]
        return model | {"terms": terms}
    df = n - k - 1
    sst, rss = spread[-1] ** 2, t[-1, -1] ** 2
    if df < 1 or not spread[-1] > 1e-13 * abs(t[0, -1]):
        return None
    inverse = np.linalg.inv(t[: k + 1, : k + 1])
    est = inverse @ t[: k + 1, -1]
    scale = (inverse**2).sum(axis=1)
    vif = scale[1:] * spread[1 : k + 1] ** 2
    sigma2 = rss / df
    se = np.sqrt(sigma2 * scale)
    with np.errstate(divide="ignore", invalid="ignore"):
        t_value = est / se
        f = ((sst - rss) / k) / sigma2 if k else np.nan
        aic = n * np.log(rss / n) + 2 * (k + 1)
    return {
        "terms": ["intercept"] + [names[i] for i in xs],
        "estimate": est.tolist(),
        "std_error": se.tolist(),
        "t_value": t_value.tolist(),
        "p_value": dist.t_tail(t_value, np.full(k + 1, df)).tolist(),
        "vif": [None, *vif.tolist()],
        "n": n,
        "r2": 1 - rss / sst,
        "adj_r2": 1 - (rss / df) / (sst / (n - 1)),
        "f_value": float(f) if k else None,
        "f_p_value": float(dist.f_tail(f, k, df)[0]) if k else None,
        "aic": float(aic),
    }


def _eliminate(fit, k: int, alpha: float, max_drop: int):
    """Drop the weakest predictor while its p exceeds alpha; keeps the last model."""
    xs = list(range(1, k + 1))
    model = fit(xs)
    if model is not None:  # a predictor without an estimate cannot stay
        xs = [x for x, e in zip(xs, model["estimate"][1:], strict=True) if e is not None]
        model = fit(xs)
    for _ in range(max_drop):
        if model is None or len(xs) < 2:
            break
        p = model["p_value"][1:]
        worst = int(np.argmax(p))
        if not p[worst] > alpha:
            break
        xs = xs[:worst] + xs[worst + 1 :]
        model = fit(xs)
    return model


def _step(fit, k: int):
    """Add or drop one predictor at a time while that lowers the criterion."""
    chosen: list[int] = []
    model = fit(chosen)
    while model is not None:
        moves = [sorted(set(chosen) ^ {x}) for x in range(1, k + 1)]
        options = [(m["aic"], xs, m) for xs in moves if (m := fit(xs)) is not None]
        best = min(options, key=lambda o: o[0], default=None)
        if best is None or not best[0] < model["aic"] - 1e-9:
            break
        _, chosen, model = best
    return model


def _modelled(df: DataFrame, group, y: str, xs, choose) -> DataFrame:
    """One chosen model per group as arrays, from one pass over the data."""
    return _solved(factors(df, group, [y, *xs]), group, y, xs, choose)


def _solved(stats: DataFrame, group, y: str, xs, choose) -> DataFrame:
    """The same from the triangles of [1, y, xs]."""
    names = [y, *xs]
    fields = [part.split()[0] for part in _MODEL.split(", ")]

    @pandas_udf(_MODEL)
    def solve(n: pd.Series, r: pd.Series) -> pd.DataFrame:
        rows = []
        for count, flat in zip(n, r, strict=True):
            full = np.asarray(flat, float).reshape(len(names) + 1, -1)
            ok = count > 1 and np.isfinite(full).all()
            model = choose(lambda s: _fit(int(count), full, s, names)) if ok else None  # noqa: B023
            # a group that has no model keeps its number of rows and NULLs for all terms
            empty = {"terms": ["intercept", *xs], "n": int(count)} | {f: [None] * len(names) for f in fields[1:6]}
            model = empty if model is None else model
            rows.append({f: model.get(f) for f in fields})
        return pd.DataFrame(rows, columns=fields, dtype=object)

    solve = solve.asNondeterministic()  # so that it runs once for all its columns
    return stats.select(*group, solve("n", "r").alias("m")).select(*group, "m.*")


def _long(models: DataFrame, group) -> DataFrame:
    parts = ["terms", "estimate", "std_error", "t_value", "p_value", "vif"]
    keep = ["n", "r2", "adj_r2", "f_value", "f_p_value", "aic"]
    return models.select(*group, *keep, F.inline(F.arrays_zip(*parts))).withColumnRenamed("terms", "term")


def _wide(models: DataFrame, group, xs) -> DataFrame:
    """One row per group: intercept, then p, coefficient and VIF of every candidate by name."""

    def at(part: str, term: str) -> Column:
        i = F.array_position("terms", term)
        return F.when(i > 0, F.try_element_at(part, i.cast("int")))

    return models.select(
        *group,
        "n",
        "adj_r2",
        at("estimate", "intercept").alias("intercept"),
        *[at("p_value", x).alias(f"{x}_pvalue") for x in xs],
        *[at("estimate", x).alias(f"{x}_coeff") for x in xs],
        *[at("vif", x).alias(f"{x}_vif") for x in xs],
    )


def ols(df: DataFrame, group, y: str, xs, interactions=()) -> DataFrame:
    """All predictors; one row per group and term.  Interactions are pairs of predictors."""
    df = df.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in interactions})
    xs = [*xs, *[f"{a}_x_{b}" for a, b in interactions]]
    return _long(_modelled(df, group, y, xs, lambda fit: fit(list(range(1, len(xs) + 1)))), group)


def ols_of(stats: DataFrame, group, y: str, xs) -> DataFrame:
    """``ols`` from triangles of [1, y, xs], as ``state.merged`` gives them."""
    xs = list(xs)
    return _long(_solved(stats, group, y, xs, lambda fit: fit(list(range(1, len(xs) + 1)))), group)


def backward_of(stats: DataFrame, group, y: str, xs, alpha: float = 0.15, max_drop: int = 2) -> DataFrame:
    """``backward`` from triangles of [1, y, xs]."""
    xs = list(xs)
    return _wide(_solved(stats, group, y, xs, lambda fit: _eliminate(fit, len(xs), alpha, max_drop)), group, xs)


def vif(df: DataFrame, group, y: str, xs) -> DataFrame:
    """Variance inflation factor per predictor, keyed by name."""
    return ols(df, group, y, xs).filter(F.col("vif").isNotNull()).select(*group, "term", "vif")


def backward(df: DataFrame, group, y: str, xs, alpha: float = 0.15, max_drop: int = 2) -> DataFrame:
    """Backward elimination; dropped predictors have NULL columns."""
    xs = list(xs)
    return _wide(_modelled(df, group, y, xs, lambda fit: _eliminate(fit, len(xs), alpha, max_drop)), group, xs)


def step_aic(df: DataFrame, group, y: str, xs) -> DataFrame:
    """Both-direction stepwise from the intercept; one row per group and kept term."""
    xs = list(xs)
    return _long(_modelled(df, group, y, xs, lambda fit: _step(fit, len(xs))), group)


def least_significant(fits: DataFrame, group) -> DataFrame:
    """The predictor with the largest p-value of each model."""
    return (
        fits.filter(F.col("term") != "intercept")
        .groupBy(*group)
        .agg(F.max_by("term", "p_value").alias("term"), F.max("p_value").alias("p_value"))
    )


def model_summary(models: DataFrame, correlations: DataFrame, group) -> DataFrame:
    """Model table with the collinearity column, joined on the group."""
    return bind_by_key(models, correlations, group)


def partial_models(df: DataFrame, group, y: str, families: dict[str, list[str]], retained: DataFrame) -> DataFrame:
    """One fit per family of predictors, each with the group's retained ones only.

    ``retained`` holds ``(group, term)``.  Terms that are not retained are NULL, and
    a family without any has a NULL intercept.  All families share one pass.
    """
    group = list(group)
    xs = [x for f in families.values() for x in f]
    names = [y, *xs]
    fields = [f"{f}_intercept" for f in families] + xs

    @pandas_udf(", ".join(f"`{c}` double" for c in fields))
    def solve(n: pd.Series, r: pd.Series, kept: pd.Series) -> pd.DataFrame:
        rows = []
        for count, flat, terms in zip(n, r, kept, strict=True):
            full = np.asarray(flat, float).reshape(len(names) + 1, -1)
            row = {}
            for family, members in families.items():
                use = [names.index(x) for x in members if x in set(terms)]
                model = _fit(int(count), full, use, names) if use and np.isfinite(full).all() else None
                if model:
                    row[f"{family}_intercept"] = model["estimate"][0]
                    row |= dict(zip(model["terms"][1:], model["estimate"][1:], strict=True))
            rows.append(row)
        return pd.DataFrame(rows, columns=fields, dtype=float)

    solve = solve.asNondeterministic()  # runs once for all its columns
    # at most one entry per candidate predictor, so the list is bounded
    kept = retained.groupBy(*group).agg(F.collect_set("term").alias("_kept"))
    stats = factors(df, group, names).join(kept, group, "left").withColumn("_kept", F.coalesce("_kept", F.array().cast("array<string>")))
    out = stats.select(*group, solve("n", "r", "_kept").alias("m")).select(*group, "m.*")
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in fields})


def predict_parts(df: DataFrame, coefs: DataFrame, group, families: dict[str, list[str]], keep) -> DataFrame:
    """Modelled value of every family, and their sum as ``full_model``.

    ``coefs`` is the output of ``partial_models``; missing coefficients count as zero.
    """
    group = list(group)
    names = {x: f"_b_{x}" for f in families.values() for x in f} | {
        f"{f}_intercept": f"_b_{f}_intercept" for f in families
    }
    rows = apply_params(df, coefs.withColumnsRenamed(names), group)

    def part(family: str) -> Column:
        out = F.coalesce(F.col(f"_b_{family}_intercept"), F.lit(0.0))
        for x in families[family]:
            out = out + F.col(x) * F.coalesce(F.col(f"_b_{x}"), F.lit(0.0))
        return out

    parts = {f"{f}_model": part(f) for f in families}
    rows = rows.withColumns(parts)
    total = sum((F.col(p) for p in list(parts)[1:]), F.col(next(iter(parts))))
    return rows.withColumn("full_model", total).select(*keep, *parts, "full_model")


def compare(obs: DataFrame, model: DataFrame, keys, group, observed: str, modelled: str) -> DataFrame:
    """Observed against modelled: n, bias, RMSE and R2."""
    diff = F.col(modelled) - F.col(observed)
    y, x = _pairwise(modelled, observed)
    joined = obs.select(*keys, observed).join(model.select(*keys, modelled), list(keys))
    return joined.groupBy(*group).agg(
        F.count(diff).alias("n"),
        F.avg(diff).alias("bias"),
        F.sqrt(F.avg(diff * diff)).alias("rmse"),
        F.regr_r2(y, x).alias("r2"),
    )


def trend_attribution(df: DataFrame, group, full: str, first: str, second: str, time: str = "year") -> DataFrame:
    """Trend of the full model and of its two parts, with signed shares."""
    slopes = df.groupBy(*group).agg(
        F.regr_slope(*_pairwise(full, time)).alias("slope"),
        F.coalesce(F.regr_slope(*_pairwise(first, time)), F.lit(0.0)).alias("first_slope"),
        F.coalesce(F.regr_slope(*_pairwise(second, time)), F.lit(0.0)).alias("second_slope"),
    )
    return slopes.withColumns(
        {
            "first_share": units.signed_share("first_slope", "second_slope"),
            "second_share": units.signed_share("second_slope", "first_slope"),
        }
    )


def trend_by_start(df: DataFrame, group, full: str, first: str, second: str, starts, time: str = "year") -> DataFrame:
    """The same trends for several start years (``time > start``), in one pass.

    A start year is a condition inside the aggregate, so rows are not copied per
    start; the few result columns are then turned into rows.
    """
    group = list(group)
    aggs = []
    for s in starts:
        t = F.when(F.col(time) > s, F.col(time))
        for c in (full, first, second):
            aggs.append(F.regr_slope(*_pairwise(c, t)).alias(f"_{s}_{c}"))
    wide = df.groupBy(*group).agg(*aggs)
    one = [
        F.struct(
            F.lit(s).alias("start_year"),
            F.col(f"_{s}_{full}").alias("slope"),
            F.coalesce(F.col(f"_{s}_{first}"), F.lit(0.0)).alias("first_slope"),
            F.coalesce(F.col(f"_{s}_{second}"), F.lit(0.0)).alias("second_slope"),
        )
        for s in starts
    ]
    return wide.select(*group, F.inline(F.array(*one))).withColumns(
        {
            "first_share": units.directed_share("first_slope", "second_slope", "slope"),
            "second_share": units.directed_share("second_slope", "first_slope", "slope"),
        }
    )


def contributions(
    z: DataFrame,
    coefs: DataFrame,
    site: str,
    group: str,
    time: str,
    z_obs: str,
    base_col: str,
    families: dict[str, list[str]],
    width: int = 5,
) -> DataFrame:
    """Deviation of the full model and of each family from the intercept model.

    Station rows are scored with the group's coefficients (``<x>_coeff`` and
    ``intercept``, NULL counts as zero), brought back to the unit of ``base_col``,
    averaged per group and time, and smoothed.
    """
    xs = [x for f in families.values() for x in f]
    params = coefs.select(group, F.col("intercept").alias("_b0"), *[
        F.coalesce(F.col(f"{x}_coeff"), F.lit(0.0)).alias(f"_b_{x}") for x in xs
    ])

    def scored(members) -> Column:
        out = F.col("_b0")
        for x in members:
            out = out + F.col(x) * F.col(f"_b_{x}")
        return out

    models = {"_full": scored(xs), "_intercept": F.col("_b0")}
    models |= {f"_{f}": scored(m) for f, m in families.items()}
    rows = apply_params(z, params, group).withColumns(models)
    rows = unzscore(rows, [site], {z_obs: "_observed"} | {c: c for c in models}, base_col, period=time)
    means = group_mean(rows, [group, time], ["_observed", *models], na_rm=False)
    named = {"_observed": "observed", "_full": "deviation"} | {f"_{f}": f for f in families}
    dev = means.select(group, time, *[(F.col(c) - F.col("_intercept")).alias(n) for c, n in named.items()])
    return centered_mean(dev, [group], [time], {n: f"smooth_{n}" for n in named.values()}, width)


def season_grid(df: DataFrame, group, runoff_season: str, y: str, precip_cols: dict[str, str]) -> DataFrame:
    """One-predictor fits for every runoff season and precipitation season.

    ``precip_cols`` maps precipitation columns to season names.  All fits of a group
    come from one aggregate over unwidened rows.
    """
    group = list(group)
    keys = [*group, runoff_season]
    aggs = []
    for c in precip_cols:
        yy, xx = _pairwise(y, c)
        aggs += [
            F.regr_count(yy, xx).cast("long").alias(f"_n_{c}"),
            F.regr_slope(yy, xx).alias(f"_b_{c}"),
            F.regr_r2(yy, xx).alias(f"_r_{c}"),
        ]
    one = [
        F.struct(
            F.lit(s).alias("season_precip"),
            F.col(f"_n_{c}").alias("n"),
            F.col(f"_b_{c}").alias("slope"),
            F.col(f"_r_{c}").alias("_r2"),
        )
        for c, s in precip_cols.items()
    ]
    fits = df.groupBy(*keys).agg(*aggs).select(
        *group, F.col(runoff_season).alias("season_runoff"), F.inline(F.array(*one))
    )
    n, r2 = F.col("n"), F.col("_r2")
    return fits.withColumns(
        {
            "adj_r2": F.when(n > 2, 1 - (1 - r2) * (n - 1) / F.when(n > 2, n - 2)),
            "p_value": _line_p(r2, n),
        }
    ).drop("_r2")


def significant(
    fits: DataFrame, alpha: float = 0.1, causal: bool = False, same_season: bool = False, strict_less: bool = False
) -> DataFrame:
    """Fits with p at most ``alpha``; optionally only causal or same-season pairs."""
    p = F.col("p_value")
    out = fits.filter(p < alpha if strict_less else p <= alpha)
    if causal:
        out = causal_pairs(out, "season_precip", "season_runoff")
    if same_season:
        out = out.filter(F.col("season_precip") == F.col("season_runoff"))
    return out


def season_significance(values: DataFrame, fits: DataFrame, group: str, season: str, precip: str, temp: str) -> DataFrame:
    """Region means per season, un-logged, with the significant same-season fit beside them."""
    means = group_mean(values, [group, season], {precip: "_p", temp: "_t"}, na_rm=False)
    own = significant(fits, 0.1, same_season=True, strict_less=True).select(
        group, F.col("season_runoff").alias(season), "slope", "adj_r2", "p_value"
    )
    joined = means.join(own, [group, season], "left")
    return joined.select(
        group,
        season,
        units.pow10("_p").alias("precip_m"),
        (units.pow10("_t") - 273.15).alias("temp_c"),
        "slope",
        "adj_r2",
        "p_value",
        F.when(F.col("p_value").isNull(), "Insignificant").otherwise("Significant").alias("significance"),
    )
