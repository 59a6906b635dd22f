"""SQL for regressions: sweeps of the covariance matrix, written out as CTEs."""

from __future__ import annotations

from itertools import combinations

from hydropanel.plans.panels import PREDICTORS


def t_p(t: str, df: str) -> str:
    """Two-sided p of a t value by the finite series for whole degrees of freedom."""
    c2 = f"({df}) / (({df}) + ({t}) * ({t}))"  # cos^2 of atan(|t| / sqrt(df))
    s = f"(abs({t}) / sqrt(({df}) + ({t}) * ({t})))"
    odd = (
        f"2 / pi() * (atan(abs({t}) / sqrt({df})) + {s} * sqrt({c2}) * sqrt(pi()) / 2 * coalesce(list_sum(list_transform("
        f"range(0, CAST((({df}) - 1) // 2 AS BIGINT)), lambda k: exp(lgamma(k + 1) - lgamma(k + 1.5) + k * ln({c2})))), 0))"
    )
    even = (
        f"{s} / sqrt(pi()) * coalesce(list_sum(list_transform("
        f"range(0, CAST(({df}) // 2 AS BIGINT)), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1) + k * ln({c2})))), 0)"
    )
    return f"CASE WHEN ({df}) >= 1 THEN greatest(0, 1 - CASE WHEN ({df}) % 2 = 1 THEN {odd} ELSE {even} END) END"


def f4_p(f: str, df2: str) -> str:
    """Upper tail of F with four numerator degrees of freedom."""
    x = f"(({df2}) / (({df2}) + 4 * ({f})))"
    return f"pow({x}, ({df2}) / 2) * (1 + ({df2}) / 2 * (1 - {x}))"


def moments(source: str, group: str, y: str, xs: list[str]) -> str:
    names = [y, *xs]
    cols = [f"avg({a}) AS m{i}" for i, a in enumerate(names)]
    cols += [f"covar_samp({a}, {b}) AS c{i}{j}" for i, a in enumerate(names) for j, b in enumerate(names)]
    some = " AND ".join(f"{a} IS NOT NULL" for a in names)
    return f"SELECT {group}, count(*) AS n, {', '.join(cols)} FROM {source} WHERE {some} GROUP BY {group}"


def sweeps(base: str, name: str, group: str, subset: tuple[int, ...], size: int) -> dict[str, str]:
    """CTEs that regress variable 0 on the subset; the last one is ``name``."""
    ids = (0, *subset)
    keep = [f"m{i}" for i in range(size)] + [f"c{i}{j}" for i in range(size) for j in range(size)]
    out, prev = {}, base
    first = [f"c{i}{j} AS a{i}{j}" for i in ids for j in ids]
    out[f"{name}_0"] = f"SELECT {group}, n, {', '.join(keep + first)} FROM {base}"
    prev = f"{name}_0"
    for step, k in enumerate(subset, 1):
        cols = []
        for i in ids:
            for j in ids:
                if i == k and j == k:
                    e = f"1 / a{k}{k}"
                elif i == k:
                    e = f"a{k}{j} / a{k}{k}"
                elif j == k:
                    e = f"-a{i}{k} / a{k}{k}"
                else:
                    e = f"a{i}{j} - a{i}{k} * a{k}{j} / a{k}{k}"
                cols.append(f"{e} AS a{i}{j}")
        this = name if step == len(subset) else f"{name}_{step}"
        out[this] = f"SELECT {group}, n, {', '.join(keep + cols)} FROM {prev}"
        prev = this
    if not subset:
        out[name] = f"SELECT * FROM {prev}"
    return out


def terms(name: str, group: str, subset: tuple[int, ...], labels: list[str]) -> str:
    """Long table of one fit: term, estimate, std_error, t_value, p_value, vif and the model columns."""
    k = len(subset)
    sigma2 = f"((n - 1) * a00 / (n - {k} - 1))"
    centre = " + ".join(f"m{i} * m{j} * a{i}{j}" for i in subset for j in subset)
    rows = [
        f"SELECT *, 'intercept' AS term, m0 - ({' + '.join(f'a{i}0 * m{i}' for i in subset)}) AS estimate, "
        f"sqrt({sigma2} * (1.0 / n + ({centre}) / (n - 1))) AS std_error, NULL::DOUBLE AS vif FROM {name}"
    ]
    for i in subset:
        rows.append(
            f"SELECT *, '{labels[i - 1]}' AS term, a{i}0 AS estimate, sqrt({sigma2} * a{i}{i} / (n - 1)) AS std_error, "
            f"a{i}{i} * c{i}{i} AS vif FROM {name}"
        )
    df = f"(n - {k} - 1)"
    return (
        f"SELECT {group}, term, estimate, std_error, estimate / std_error AS t_value, {t_p('estimate / std_error', df)} AS p_value, "
        f"vif, n, 1 - a00 / c00 AS r2, 1 - a00 / c00 * (n - 1) / {df} AS adj_r2, "
        f"(c00 - a00) / {k} / (a00 / {df}) AS f_value FROM ({' UNION ALL '.join(rows)})"
    )


def all_subsets(source: str, group: str, y: str, xs: list[str] = PREDICTORS) -> dict[str, str]:
    """``fits``: one row per group and subset (bit mask) with wide columns, and AIC of every subset."""
    size = len(xs) + 1
    ctes = {"moments": moments(source, group, y, xs)}
    parts = []
    for k in range(0, size):
        for subset in combinations(range(1, size), k):
            mask = sum(1 << (i - 1) for i in subset)
            name = f"fit{mask}"
            ctes |= sweeps("moments", name, group, subset, size)
            cols = [
                f"{mask} AS mask", f"{k} AS k", "n", f"1 - a00 / c00 * (n - 1) / (n - {k} - 1) AS adj_r2",
                f"n * ln((n - 1) * a00 / n) + 2 * {k + 1} AS aic",
                "m0" + "".join(f" - a{i}0 * m{i}" for i in subset) + " AS intercept",
            ]
            for i, x in enumerate(xs, 1):
                if i in subset:
                    se = f"sqrt((n - 1) * a00 / (n - {k} - 1) * a{i}{i} / (n - 1))"
                    cols += [
                        f"{t_p(f'a{i}0 / {se}', f'(n - {k} - 1)')} AS {x}_pvalue",
                        f"a{i}0 AS {x}_coeff",
                        f"a{i}{i} * c{i}{i} AS {x}_vif",
                    ]
                else:
                    cols += [f"NULL::DOUBLE AS {x}_{c}" for c in ("pvalue", "coeff", "vif")]
            parts.append(f"SELECT {group}, {', '.join(cols)} FROM {name}")
    ctes["fits"] = " UNION ALL ".join(parts)
    return ctes


def backward_path(group: str, alpha: float = 0.15, xs: list[str] = PREDICTORS) -> dict[str, str]:
    """``chosen``: the fit that is left after at most two eliminations."""
    worst = f"greatest({', '.join(f'{x}_pvalue' for x in xs)})"
    bit = "CASE " + " ".join(f"WHEN {x}_pvalue = {worst} THEN {1 << i}" for i, x in enumerate(xs)) + " END"
    drop = f"CASE WHEN {worst} > {alpha}::DOUBLE AND k > 1 THEN mask - {bit} ELSE mask END"
    full = (1 << len(xs)) - 1
    return {
        "drop1": f"SELECT {group}, {drop} AS mask FROM fits WHERE mask = {full}",
        "drop2": f"SELECT {group}, {drop} AS mask FROM fits JOIN drop1 USING ({group}, mask)",
        "chosen": f"SELECT fits.* FROM fits JOIN drop2 USING ({group}, mask)",
    }


def aic_path(group: str, xs: list[str] = PREDICTORS) -> dict[str, str]:
    """``stepped``: mask after repeated best single additions or removals."""
    bits = ", ".join(str(b) for b in [0, *(1 << i for i in range(len(xs)))])
    out = {"step0": f"SELECT DISTINCT {group}, 0 AS mask FROM fits"}
    for i in range(1, 9):
        out[f"step{i}"] = (
            f"SELECT s.{group}, arg_min(f.mask, f.aic) AS mask FROM "
            f"(SELECT {group}, xor(mask, unnest([{bits}])) AS mask FROM step{i - 1}) s "
            f"JOIN fits f ON f.{group} = s.{group} AND f.mask = s.mask GROUP BY s.{group}"
        )
    out["stepped"] = "SELECT * FROM step8"
    return out


def wide_columns(xs: list[str] = PREDICTORS) -> list[str]:
    return ["adj_r2", "intercept", *[f"{x}_{c}" for c in ("pvalue", "coeff", "vif") for x in xs]]
