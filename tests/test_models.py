"""Regressions, regions and spatial operators against brute force."""

import collections
import hashlib
import itertools
import os
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hydropanel import session
from hydropanel.functions import dist, geo
from hydropanel.operators import aggregates, apply, cover, extremes, factors, kriging, pairs, ranges, regions, spatial, state, transfer, windows, zones
from hydropanel.operators import regression as reg
from hydropanel.sources import checkpoint_table

XS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": np.repeat([1, 2, 3], 40), **{x: rng.normal(size=120) for x in XS}})
    pdf["y"] = 2 + 1.5 * pdf["a"] - 0.5 * pdf["b"] * (pdf["g"] == 2) + rng.normal(scale=0.5, size=120)
    pdf.loc[3, "a"] = np.nan
    return pdf


@pytest.fixture(scope="module")
def frame(spark, data):
    df = spark.createDataFrame(data)
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ["y", *XS]})


def brute(pdf, xs):
    pdf = pdf.dropna()
    x = np.column_stack([np.ones(len(pdf)), *[pdf[c] for c in xs]])
    beta, *_ = np.linalg.lstsq(x, pdf["y"], rcond=None)
    rss = ((pdf["y"] - x @ beta) ** 2).sum()
    n, k = x.shape
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * rss / (n - k))
    return beta, se, rss, n


def test_simple_fit(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 3.0), (1, 3.0, 5.0), (2, 1.0, 1.0), (2, 1.0, 2.0)], "g int, x double, y double")
    got = {r.g: r for r in reg.simple_fit(df, ["g"], "y", "x").collect()}
    assert got[1].slope == 1.5 and got[1].intercept == pytest.approx(1 / 3) and got[1].r2 == pytest.approx(0.964286, abs=1e-6)
    assert got[2].slope is None
    exact = spark.createDataFrame([(1, float(i), 2.0 * i) for i in range(4)] + [(2, float(i), 3.0 * i) for i in range(2)], "g int, x double, y double")
    p = {r.g: r.p_value for r in reg.simple_fit(exact, ["g"], "y", "x").collect()}
    assert p[1] == 0.0 and p[2] is None


def test_ols_matches_least_squares(frame, data):
    got = reg.ols(frame, ["g"], "y", XS).toPandas()
    for g, part in data.groupby("g"):
        beta, se, rss, n = brute(part, XS)
        mine = got[got.g == g].set_index("term").loc[["intercept", *XS]]
        assert mine["estimate"].to_numpy() == pytest.approx(beta)
        assert mine["std_error"].to_numpy() == pytest.approx(se)
        assert mine["p_value"].to_numpy() == pytest.approx(dist.t_tail(beta / se, np.full(4, n - 4)))
        assert (mine["vif"].dropna() >= 1).all()


def test_interaction(frame, data):
    got = reg.ols(frame, ["g"], "y", ["a", "b"], [("a", "b")]).toPandas()
    one = data[data.g == 2].assign(ab=lambda d: d.a * d.b)
    beta, *_ = brute(one, ["a", "b", "ab"])
    mine = got[got.g == 2].set_index("term").loc[["intercept", "a", "b", "a_x_b"], "estimate"]
    assert mine.to_numpy() == pytest.approx(beta)


def test_backward_drops_noise_by_name(frame, data):
    got = {r.g: r for r in reg.backward(frame, ["g"], "y", XS, 0.15, 2).collect()}
    for g, part in data.groupby("g"):
        xs = list(XS)
        for _ in range(2):
            beta, se, _, n = brute(part.dropna(), xs)
            p = dist.t_tail(beta / se, np.full(len(xs) + 1, n - len(xs) - 1))[1:]
            if p.max() <= 0.15:
                break
            xs.pop(int(p.argmax()))
        for x in XS:
            assert (got[g][f"{x}_coeff"] is None) == (x not in xs)
            assert (got[g][f"{x}_pvalue"] is None) == (x not in xs)
    assert got[2].b_coeff is not None


def test_step_aic_is_a_local_minimum(frame, data):
    got = reg.step_aic(frame, ["g"], "y", XS).toPandas()
    for g, part in data.groupby("g"):
        def aic(xs):
            _, _, rss, n = brute(part.dropna(), list(xs))
            return n * np.log(rss / n) + 2 * (len(xs) + 1)

        kept = set(got[(got.g == g) & (got.term != "intercept")].term)
        best = aic(sorted(kept))
        assert got[got.g == g].aic.iloc[0] == pytest.approx(best)
        assert all(aic(sorted(kept ^ {x})) >= best - 1e-9 for x in XS)


def test_degenerate_groups_keep_their_rows(spark):
    rows = [(1, 1.0, 1.0, 2.0), (1, 2.0, 2.0, 3.0), (1, 3.0, 3.0, 5.0), (1, 4.0, 4.0, 6.0), (1, 5.0, 5.0, 7.5), (2, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "g int, a double, b double, y double")
    got = {(r.g, r.term): r for r in reg.ols(df, ["g"], "y", ["a", "b"]).collect()}
    assert len(got) == 6 and got[1, "a"].estimate is not None and got[1, "b"].estimate is None  # collinear: the later one has no estimate
    assert all(got[2, t].estimate is None and got[2, t].n == 1 for t in ("intercept", "a", "b"))  # too few rows


def test_partial_models_use_retained_terms_only(spark, frame, data):
    kept = spark.createDataFrame([(1, "a"), (1, "c"), (2, "b")], "g long, term string")
    got = {r.g: r for r in reg.partial_models(frame, ["g"], "y", {"first": ["a", "b"], "second": ["c"]}, kept).collect()}
    beta, *_ = brute(data[data.g == 1].dropna(), ["a"])
    assert (got[1].first_intercept, got[1].a) == (pytest.approx(beta[0]), pytest.approx(beta[1]))
    assert got[1].b is None and got[1].c is not None
    assert got[2].c is None and got[2].second_intercept is None and got[3].first_intercept is None and got[3].a is None


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.floats(-50, 50, allow_nan=False)), min_size=1, max_size=30))
def test_two_level_mean_property(spark, values):
    df = spark.createDataFrame([(f"s{s}", s % 2, v) for s, v in values], "s string, c int, v double")
    pdf = df.toPandas()
    for r in aggregates.two_level_mean(df, "s", "c", "v").collect():
        assert r.site_mean == pytest.approx(pdf[pdf.s == r.s].v.mean(), abs=1e-9)
        assert r.region_mean == pytest.approx(pdf[pdf.c == r.c].v.mean(), abs=1e-9)


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"id": np.arange(120), "k": rng.integers(0, 3, 120), "x": rng.normal(size=120), "y": rng.normal(size=120)})
    pdf.loc[0, "k"] = 9  # a cluster of one
    pdf["z"] = pdf["x"] + rng.normal(scale=0.1, size=120)
    # a third of all rows at one place
    pdf.loc[80:, ["x", "y"]] = 0.25
    return pdf, spark.createDataFrame(pdf).withColumn("v", F.array("x", "y"))


@pytest.mark.parametrize("block", [17, 1000])
def test_silhouette_and_dunn(cloud, block):
    pdf, df = cloud
    d = np.hypot(*(pdf[c].to_numpy()[:, None] - pdf[c].to_numpy() for c in ("x", "y")))
    got = regions.silhouette(df, "id", "v", "k", block).toPandas().set_index("id")
    k = pdf.k.to_numpy()
    for i in range(len(pdf)):
        own = (k == k[i]) & (np.arange(len(k)) != i)
        if not own.any():
            assert got.silhouette[i] == 0
            continue
        a, b = d[i, own].mean(), min(d[i, k == c].mean() for c in set(k) - {k[i]})
        assert got.silhouette[i] == pytest.approx((b - a) / max(a, b))
    one = regions.dunn(df, "id", "v", "k", block).first()
    other = k[:, None] != k
    assert one.separation == pytest.approx(d[other].min()) and one.diameter == pytest.approx(d[~other].max())


@pytest.mark.parametrize("cutoff", [None, 0.7])
def test_variogram(cloud, cutoff):
    pdf, df = cloud
    got = spatial.variogram(df, "x", "y", "z", cutoff, bins=6).toPandas().set_index("bin")
    reach = cutoff or np.hypot(np.ptp(pdf.x), np.ptp(pdf.y)) / 3
    sums = {}
    for i, j in itertools.combinations(range(len(pdf)), 2):
        d = np.hypot(pdf.x[i] - pdf.x[j], pdf.y[i] - pdf.y[j])
        if 0 < d <= reach:
            s = sums.setdefault(int(np.ceil(d / (reach / 6))), [0, 0.0, 0.0])
            s[0] += 1
            s[1] += d
            s[2] += (pdf.z[i] - pdf.z[j]) ** 2
    assert set(got.index) == set(sums)
    for b, (n, d, q) in sums.items():
        assert got.np[b] == n and got.dist[b] == pytest.approx(d / n)
        assert got.gamma[b] == pytest.approx(q / 2 / n / pdf.z.var())


@pytest.mark.parametrize("cutoff", [0.05, 0.4, 2.0])
def test_variogram_sums_by_leaves(cutoff, monkeypatch):
    """Many places against all pairs one by one, whole and cut bins alike; few pairs get a bin of their own."""
    rng = np.random.default_rng(3)
    z = rng.normal(size=1500)
    rows = np.c_[np.r_[rng.uniform(size=(1200, 2)), np.round(rng.uniform(size=(300, 2)), 1) + 1e-4 * np.arange(300)[:, None]] + 1000, rng.integers(1, 4, 1500), z, z * z + 1]
    d = np.hypot(*(rows[:, [c]] - rows[:, c] for c in (0, 1)))
    count = rows[:, [2]] * rows[:, 2]
    square = rows[:, 2] * rows[:, [4]] + rows[:, [2]] * rows[:, 4] - 2 * rows[:, [3]] * rows[:, 3]
    single = []
    plain = spatial.distances
    monkeypatch.setattr(spatial, "distances", lambda a, b: single.append(len(a) * len(b)) or plain(a, b))
    upper, early = np.triu(np.ones(d.shape, bool), 1), np.arange(1500) < 700
    for of, got in ((upper, spatial._binned(rows, None, cutoff, 10)), (early[:, None] & ~early, spatial._binned(rows[:700], rows[700:], cutoff, 10))):
        use = of & (d > 0) & (d <= cutoff)
        k = np.ceil(d[use] / (cutoff / 10)).astype(int) - 1
        for have, w in zip(got, (count, count * d, square), strict=True):
            assert have == pytest.approx(np.bincount(k, weights=w[use], minlength=10), rel=1e-9, abs=1e-9)
    assert cutoff < 1 or sum(single) < 0.9 * 1500 * 1499 / 2 + 700 * 800 * 0.9
    monkeypatch.undo()


def test_variogram_fit_recovers_a_model(spark):
    h = np.linspace(0.5, 10, 15)
    rows = [(i + 1, 100, float(x), float(0.2 + 0.8 * (1 - np.exp(-x / 3.0))), 10.0) for i, x in enumerate(h)]
    vg = spark.createDataFrame(rows, "bin int, np long, dist double, gamma double, cutoff double")
    fit = spatial.fit_variogram(vg).first()
    assert fit.kind == "Exp" and fit.range == pytest.approx(3.0, rel=1e-3)
    assert (fit.nugget, fit.psill) == (pytest.approx(0.2, abs=1e-4), pytest.approx(0.8, abs=1e-4))


@pytest.mark.parametrize(("kind", "nugget", "task_cells"), [("Exp", 0.0, 100), ("Sph", 0.3, 2)])
def test_kriging_against_brute_force(spark, kind, nugget, task_cells):
    rng = np.random.default_rng(2)
    pts = pd.DataFrame({"x": rng.uniform(0, 10, 60), "y": rng.uniform(0, 10, 60), "z": rng.normal(size=60)})
    cells = pd.DataFrame({"ix": np.arange(12), "iy": 0, "x": rng.uniform(0, 10, 12), "y": rng.uniform(0, 10, 12)})
    cells.loc[0, ["x", "y"]] = pts.loc[0, ["x", "y"]]  # on a station
    cells.loc[1, ["x", "y"]] = 99.0  # nobody near
    model = spark.createDataFrame([(kind, 2.0, nugget, 1.0)], "kind string, range double, nugget double, psill double")
    df, grid = spark.createDataFrame(pts), spark.createDataFrame(cells)
    got = spatial.krige(df, grid, model, "x", "y", "z", maxdist=3.0, task_cells=task_cells).toPandas().set_index("ix")

    def cov(h):
        if kind == "Exp":
            return np.exp(-h / 2.0)
        u = np.minimum(h / 2.0, 1)
        return 1 - 1.5 * u + 0.5 * u**3

    for c in cells.itertuples():
        near = np.hypot(pts.x - c.x, pts.y - c.y) <= 3.0
        p = pts[near]
        if not len(p):
            assert np.isnan(got.prediction[c.ix])
            continue
        h = np.hypot(p.x.to_numpy()[:, None] - p.x.to_numpy(), p.y.to_numpy()[:, None] - p.y.to_numpy())
        n = len(p)
        a = np.ones((n + 1, n + 1))
        a[:n, :n], a[n, n] = cov(h) + nugget * np.eye(n), 0
        h0 = np.hypot(p.x - c.x, p.y - c.y).to_numpy()
        b = np.append(cov(h0) + nugget * (h0 == 0), 1.0)
        w = np.linalg.solve(a, b)
        assert got.prediction[c.ix] == pytest.approx(w[:n] @ p.z)
        assert got.variance[c.ix] == pytest.approx(1 + nugget - w @ b, abs=1e-9)
    assert got.prediction[0] == pytest.approx(pts.z[0]) and got.variance[0] == pytest.approx(0, abs=1e-9)


def _places(n, seed=1):
    rng = np.random.default_rng(seed)
    xy = rng.uniform(0, 4, (n, 2))
    return xy, rng.normal(size=n), rng.integers(1, 4, n), np.r_[rng.uniform(0.5, 3.5, (6, 2)), xy[:1]]


@pytest.mark.parametrize(("kind", "reach", "nugget", "sub"), [("Exp", 1.0, 0.1, 1), ("Exp", 3.0, 0.0, 1), ("Sph", 1.0, 0.05, 2), ("Sph", 2.0, 0.0, 1), ("Exp", 1.0, 0.3, 2)])
def test_kriging_by_conjugate_gradients_is_the_dense_solve(kind, reach, nugget, sub):
    xy, z, times, cells = _places(700)
    offsets = np.zeros((1, 2)) if sub == 1 else np.array([[a, b] for a in (-0.05, 0.05) for b in (-0.05, 0.05)])
    with_all = [kriging.predict(xy, z, nugget / times, cells, (kind, reach, 1.0), 2.5, offsets, nugget, dense) for dense in (5, 10_000)]
    for got, want in zip(*with_all, strict=True):
        assert np.abs(got - want).max() < 1e-8


def test_kriging_memory_does_not_follow_the_square_of_the_stations():
    peak = {}
    for n in (300, 3000):
        xy, z, *_ = _places(n)
        tracemalloc.start()
        kriging.predict(xy, z, np.full(n, 0.1), np.array([[2.0, 2.0]]), ("Exp", 1.0, 1.0), 9.0, np.zeros((1, 2)), 0.1, 100)
        peak[n] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert peak[3000] < 8 * 3000 * 3000  # one dense matrix
    assert peak[3000] < 64e6


def test_kriging_of_many_stations_without_sill():
    xy, z, times, cells = _places(700)
    p, _ = kriging.predict(xy, z, np.zeros(700), cells[:1], ("Exp", 1.0, 0.0), 9.0, np.zeros((1, 2)), 0.0, 5)
    assert p[0] == pytest.approx(z.mean())
    p, _ = kriging.predict(xy, z, 0.5 / times, cells[:1], ("Exp", 1.0, 0.0), 9.0, np.zeros((1, 2)), 0.5, 5)
    assert p[0] == pytest.approx((z * times).sum() / times.sum())


def test_kriging_without_variance_is_the_mean(spark):
    pts = spark.createDataFrame([(0.0, 0.0, 1.0), (1.0, 0.0, 2.0), (0.0, 1.0, 6.0)], "x double, y double, z double")
    cells = spark.createDataFrame([(0, 0, 0.5, 0.5)], "ix long, iy long, x double, y double")
    model = spark.createDataFrame([("Exp", 1.0, 0.0, 0.0)], "kind string, range double, nugget double, psill double")
    got = spatial.krige(pts, cells, model, "x", "y", "z", maxdist=3.0).first()
    assert got.prediction == pytest.approx(3.0) and got.variance == pytest.approx(0.0)


@pytest.mark.parametrize("reach", [400.0, 40_000.0, 300_000.0])
def test_fit_finds_ranges_below_and_above_the_cutoff(spark, reach):
    rows = [(k, 1000 * k, 1000.0 * k - 500, 0.2 + 0.8 * (1 - np.exp(-(1000.0 * k - 500) / reach)), 15_000.0) for k in range(1, 16)]
    vg = spark.createDataFrame([(a, b, c, float(d), e) for a, b, c, d, e in rows], "bin int, np long, dist double, gamma double, cutoff double")
    got = spatial.fit_variogram(vg).first()
    assert got.kind == "Exp" and got.range == pytest.approx(reach, rel=0.01) and got.psill == pytest.approx(0.8, rel=0.01)


def _star(x, y, r, n, seed):
    """A ragged ring whose corners often lie on cell borders and on the points' latitudes."""
    rng = np.random.default_rng(seed)
    turn = np.sort(rng.uniform(0, 2 * np.pi, n))
    far = r * rng.uniform(0.3, 1.0, n)
    return [(round(float(a) * 8) / 8, round(float(b) * 8) / 8) for a, b in zip(x + far * np.cos(turn), y + far * np.sin(turn), strict=True)]


def test_points_meet_one_large_among_many_small_polygons(spark):
    """The cover gives what the test of the whole ring gives, also for points on corners, edges and cell borders."""
    rows = [("large", [_star(0, 0, 60, 400, 1), _star(3, 2, 9, 30, 2)]), ("empty", []), ("none", None), ("flat", [[(1.0, 1.0), (5.0, 1.0)]])]
    rows += [(f"s{i}", [_star(-20 + 4.5 * i, 7 - i, 1.5, 12, 10 + i)]) for i in range(10)]
    polys = spark.createDataFrame(rows, "identifier string, ring array<array<struct<lon:double,lat:double>>>")
    rng = np.random.default_rng(3)
    xy = np.r_[rng.uniform(-65, 65, (3000, 2)), np.round(rng.uniform(-65, 65, (3000, 2)) * 8) / 8, np.round(rng.uniform(-30, 30, (3000, 2)))]
    corners = [v for _, rings in rows for r in rings or [] for v in r]
    places = [(i, float(a), float(b)) for i, (a, b) in enumerate([*map(tuple, xy), *corners])] + [(-1, None, 1.0)]
    points = spark.createDataFrame(places, "cell_id long, lon double, lat double")
    plain = points.crossJoin(polys).where(geo.in_polygon(F.col("lon"), F.col("lat"), F.col("ring")))
    want = {(r.cell_id, r.identifier) for r in plain.select("cell_id", "identifier").collect()}
    for tile in (1.0, 3.0, 0.25):
        got = [(r.cell_id, r.identifier) for r in spatial.points_in_polygons(points, polys, tile=tile).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_points_are_tested_in_slices_of_a_crowded_cell(spark, monkeypatch):
    """Points and polygons of one cell meet in batches of any size, with repeated rows and columns of the same name on both sides."""
    monkeypatch.setattr(spatial, "POINTS", 40)
    monkeypatch.setattr(spatial, "TESTS", 200)
    polys = spark.createDataFrame([(f"s{k % 20}", k, [_star(0.1 * k, 0.05 * k, 1.5, 12, k % 20)]) for k in (*range(20), 3)], "id string, n int, ring array<array<struct<lon:double,lat:double>>>")
    xy = np.random.default_rng(1).uniform(-2, 4, (300, 2))
    points = spark.createDataFrame([(i % 290, None if i % 7 else f"name {i}", float(a), float(b)) for i, (a, b) in enumerate(xy)] + [(-1, "x", None, 0.0)], "id long, name string, lon double, lat double")
    found = spatial.points_in_polygons(points, polys)
    assert found.columns == ["id", "name", "lon", "lat", "id", "n"] and "CoGroup" in found._jdf.queryExecution().optimizedPlan().toString()
    plain = points.crossJoin(polys.withColumnRenamed("id", "other")).where(geo.in_polygon(F.col("lon"), F.col("lat"), F.col("ring"))).drop("ring")
    want = collections.Counter(tuple(r) for r in plain.collect())
    assert collections.Counter(tuple(r) for r in found.collect()) == want and len(want) > 300


def test_cover_follows_the_border():
    """No more cells than edges, whatever the area; no cell on the border has many edges."""
    def cells(r):
        ring = np.array([(r * np.cos(t), r * np.sin(t)) for t in np.linspace(0, 2 * np.pi, int(40 * r), endpoint=False)])
        return list(cover.cells_of([ring], 0.125))

    large = cells(16)
    assert all(len(cells(r)) <= 40 * r for r in (4, 8, 16, 64))
    assert max(len(c[-1]) for c in large) <= cover.EDGES and any(c[3] for c in large)
    area = sum((0.125 * cover.SPLIT ** c[0]) ** 2 for c in large if c[3])
    assert 0.8 * np.pi * 256 < area < np.pi * 256


def _area_in_square(ring, a, b, c, d):
    """Area of a ring in [a, b] x [c, d], edge by edge: the distance to the left side integrated over latitude."""
    total = 0.0
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        lo, hi = max(min(y1, y2), c), min(max(y1, y2), d)
        if hi <= lo:
            continue
        ys = [lo, hi, *[y for x in (a, b) if x1 != x2 for y in [y1 + (x - x1) * (y2 - y1) / (x2 - x1)] if lo < y < hi]]
        ys.sort()
        wide = [min(max(x1 + (y - y1) * (x2 - x1) / (y2 - y1), a), b) - a for y in ys]
        total += (1 if y2 > y1 else -1) * sum((u + v) / 2 * (q - p) for p, q, u, v in zip(ys, ys[1:], wide, wide[1:], strict=False))
    return abs(total)


@pytest.mark.parametrize("size", [0.5, 0.7, 3.0])
def test_cells_are_cut_by_polygons(spark, size):
    """Areas of cells cut by a ragged outline with a hole, an island in it and a part beside it, either way round."""
    rng = np.random.default_rng(4)

    def ragged(x, y, r, n):
        turn = np.sort(rng.uniform(0, 2 * np.pi, n))
        far = r * rng.uniform(0.7, 1.0, n)
        return [(float(a), float(b)) for a, b in zip(x + far * np.cos(turn), y + far * np.sin(turn), strict=True)]

    rings = [ragged(0, 0, 8, 300), ragged(1, 0, 3, 60)[::-1], ragged(1, 0, 1, 12), ragged(14, 1, 3, 20)[::-1]]
    polys = spark.createDataFrame([("p", rings), ("empty", []), ("none", None), ("line", [[(0.0, 0.0), (1.0, 1.0)]])], "identifier string, ring array<array<struct<lon:double,lat:double>>>")
    cells = [(i, float(x), float(y), 7) for i, (x, y) in enumerate(np.r_[rng.uniform(-9, 17, (250, 2)), [(0.0, 0.0), (0.5, 0.5), (14.0, 1.0)]])]
    table = spark.createDataFrame([*cells, (-1, None, 0.0, 7)], "cell_id long, lon double, lat double, area int").drop("area")
    cut = spatial.intersection(table, polys, size).collect()
    got = {r.cell_id: r.area for r in cut}
    assert len(got) == len(cut) and {r.identifier for r in cut} == {"p"}
    h = size / 2
    want = {i: sum(s * _area_in_square(r, x - h, x + h, y - h, y + h) for s, r in zip((1, -1, 1, 1), rings, strict=True)) for i, x, y, _ in cells}
    for i, area in want.items():
        assert got.get(i, 0.0) == pytest.approx(area, abs=1e-9)
    share = {r.cell_id: r.share for r in spatial.coverage(table, polys, size).collect()}
    assert share == pytest.approx({i: a / size**2 for i, a in got.items()})
    assert spatial.intersection(table, polys.where("identifier = 'empty'"), size).count() == 0


def test_squares_beside_a_piece_are_not_cut(spark):
    """Squares of the same large cell whose box misses the polygon, or only touches it, never leave the join."""
    ring = [(0.25, 0.25), (0.75, 0.25), (0.75, 0.75), (0.25, 0.75)]
    polys = spark.createDataFrame([("p", ring)], "identifier string, ring array<struct<lon:double,lat:double>>")
    at = [0.0, 0.1, 0.5, 0.9, 1.0, 3.0]
    cells = spark.createDataFrame([(6 * i + j, x, y) for i, x in enumerate(at) for j, y in enumerate(at)], "cell_id long, lon double, lat double")
    cut = spatial.intersection(cells, polys, 0.5)
    near = {0.1: 0.1, 0.5: 0.5, 0.9: 0.1}
    got = {r.cell_id: r.area for r in cut.collect()}
    assert got == pytest.approx({6 * i + j: near[x] * near[y] for i, x in enumerate(at) for j, y in enumerate(at) if x in near and y in near})
    join = next(line for line in cut._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line)
    assert all(name in join for name in ("_lon0", "_lon1", "_lat0", "_lat1"))


def test_tiles_hold_all_of_a_polygon_around_their_squares():
    """Rings clipped to tiles wider by half a square give the whole cut of every square with its centre in the tile, to rounding."""
    rng = np.random.default_rng(6)
    rings = [np.array(_star(0, 0, 8, 120, 1)), np.array(_star(14, 1, 3, 20, 2))[::-1]]
    half = 0.25
    parts = list(cover.pieces_of(rings, 2.0, 64, -1, half))
    lon, lat = rng.uniform(-9, 18, 400), np.sort(rng.uniform(-9, 9, 400))
    want = np.array([sum(_area_in_square(list(map(tuple, r)), x - half, x + half, y - half, y + half) for r in rings) for x, y in zip(lon, lat, strict=True)])
    got, cut, met = np.zeros(400), np.zeros(400), np.zeros(400, int)
    for level, cx, cy, own in parts:
        size = cover.size_of(level, 2.0)
        mine = np.flatnonzero((np.floor(lon / size) == cx) & (np.floor(lat / size) == cy))
        met[mine] += 1
        got[mine] += cover.areas_in_squares(lon[mine], lat[mine], half, np.concatenate(own).ravel(), np.array([len(r) for r in own]))
        for r in own:
            n = len(mine)
            *_, area = cover.cut_by_squares(np.tile(r[:, 0], n), np.tile(r[:, 1], n), np.arange(n + 1) * len(r), lon[mine], lat[mine], half)
            cut[mine] += area
    assert met.max() == 1 and (want > 0.01).sum() > 100
    assert np.abs(got - want).max() < 1e-12 and np.abs(cut - want).max() < 1e-12


def test_cuts_are_not_put_together_in_a_shuffle(spark, monkeypatch):
    """A square meets all of a polygon in one row, whatever the slices, so nothing is grouped behind the cut; repeated rows add up."""
    rings = {"p": [_star(0, 0, 8, 40, 1)], "q": [_star(1, 1, 6, 90, 2)]}
    kind = "identifier string, ring array<array<struct<lon:double,lat:double>>>"
    polys = spark.createDataFrame([*rings.items(), ("q", rings["q"])], kind)
    rng = np.random.default_rng(7)
    at = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-9, 9, (150, 2)))]
    cells = spark.createDataFrame([*at, at[0]], "cell_id long, lon double, lat double")
    monkeypatch.setattr(spatial, "PAIRS", 20)
    cut = spatial.intersection(cells, polys, 0.7)
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan
    h = 0.35
    one = {(i, k): _area_in_square(r[0], x - h, x + h, y - h, y + h) * (2 if k == "q" else 1) * (2 if i == 0 else 1) for i, x, y in at for k, r in rings.items()}
    got = {(r.cell_id, r.identifier): (r.area, r.whole) for r in cut.withColumn("whole", F.aggregate("pieces", F.lit(0.0), lambda t, piece: t + geo.ring_area(piece))).collect()}
    for pair, area in one.items():
        assert got.pop(pair, (0.0, 0.0)) == pytest.approx((area, area), abs=1e-9)
    assert not got
    # an identifier with several shapes is one polygon
    both = spark.createDataFrame([("s", rings["p"]), ("s", rings["q"])], kind)
    found = {r.cell_id: r.area for r in spatial.intersection(cells, both, 0.7).collect()}
    assert found == pytest.approx({i: a for i, *_ in at if (a := one[i, "p"] + one[i, "q"] / 2) > 1e-9})


def test_zonal_mean_keeps_polygons_without_a_cell(spark):
    ring = lambda x: [(x, 0.0), (x + 0.1, 0.0), (x + 0.1, 0.1), (x, 0.1)]
    polys = spark.createDataFrame([("a", ring(0.0)), ("b", ring(5.0))], "identifier string, ring array<struct<lon:double,lat:double>>")
    cells = spark.createDataFrame([(1, 0.05, 0.05, "t", 3.0)], "cell_id long, lon double, lat double, time string, value double")
    got = {r.identifier: (r.time, r["mean"], r.n_cells) for r in spatial.zonal_mean(cells, polys).collect()}
    assert got == {"a": ("t", 3.0, 1), "b": (None, None, 0)}


def _zones(spark, rng):
    """Crowded cells and polygons: rings with holes, one identifier with two shapes, polygons and cells listed twice, a cell at two places, odd values."""

    def ragged(x, y, r, n):
        turn = np.sort(rng.uniform(0, 2 * np.pi, n))
        return [(float(x + r * np.cos(t)), float(y + r * np.sin(t))) for t in turn]

    at = rng.uniform(-4, 4, (60, 2))
    shapes = [(f"p{k}", [ragged(x, y, rng.uniform(0.1, 3), 9), ragged(x, y, 0.5, 40)]) for k, (x, y) in enumerate(at)]
    shapes += [("p0", [ragged(3, 0, 20, 30)]), shapes[1], shapes[1], (None, shapes[2][1]), ("none", None), ("far", [ragged(99, 0, 1, 5)])]
    polys = spark.createDataFrame(shapes, "identifier string, ring array<array<struct<lon:double,lat:double>>>")
    cells = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-5, 5, (300, 2)))]
    cells += [cells[3], (4, 2.0, 2.0), (None, 0.0, 0.0), (900, None, 0.0), (901, float("nan"), 0.0)]
    centres = spark.createDataFrame(cells, "cell_id long, lon double, lat double")
    odd = {(7, 0): None, (8, 1): float("inf"), (9, 2): float("nan")}
    values = [(k, f"t{t}" if t else None, odd.get((k, t), float(v))) for k in range(300) for t, v in enumerate(rng.normal(5, 1, 70)) if (k + t) % 3]
    return centres, polys, spark.createDataFrame([*values, values[0], (None, "t1", 1.0)], "cell_id long, time string, value double").withColumn("w", F.when(F.col("cell_id") != 11, 1 + F.col("cell_id") % 2))


def _same_means(got, want):
    got, want = ({(r.identifier, r.time): (r["mean"], r.n_cells) for r in rows.collect()} for rows in (got, want))
    assert got.keys() == want.keys() and len(got) > 3000
    for k, (mean, n) in want.items():
        assert got[k][1] == n and (got[k][0] is mean if mean is None else got[k][0] == pytest.approx(mean, rel=1e-9, nan_ok=True)), k


def test_shares_are_summed_where_they_are_found(spark, monkeypatch, weight="w"):
    """The means by pairs of cells and polygons, from rows that grow with the polygons only, in slices of any size."""
    centres, polys, values = _zones(spark, np.random.default_rng(3))
    pairs = spatial.coverage(centres, polys, 0.5, sub=2)
    want = spatial.zonal_mean(values, polys, weight=weight, cover=pairs)
    for rows, sums in ((zones.ROWS, zones.SUMS), (500, 300)):
        monkeypatch.setattr(zones, "ROWS", rows)
        monkeypatch.setattr(zones, "SUMS", sums)
        cover = spatial.coverage(centres, polys, 0.5, sub=2, values=values, weight=weight)
        _same_means(spatial.zonal_mean(values, polys, weight=weight, cover=cover), want)
    few = centres.where("cell_id BETWEEN 10 AND 299")
    copies = few.crossJoin(spark.range(20)).select((F.col("cell_id") * 20 + F.col("id")).alias("cell_id"), "lon", "lat")
    once = polys.where("identifier LIKE 'p_'").dropDuplicates(["identifier"])
    monkeypatch.undo()
    n = [spatial.coverage(c, once, 0.5, sub=2, values=c.select("cell_id", F.lit(1).alias("time"), F.lit(2.0).alias("value"))).count() for c in (few, copies)]
    assert n[0] == n[1] <= 60 and spatial.coverage(copies, once, 0.5, sub=2).count() > 20 * n[1]


def test_areas_are_summed_where_they_are_found(spark, monkeypatch):
    """The means by pairs with their areas, from tasks that hold a slice of a crowded place; small shares do not count."""
    centres, polys, values = _zones(spark, np.random.default_rng(4))
    pairs = spatial.coverage(centres, polys, 0.5, least=0.2)
    assert 0 < pairs.count() < spatial.coverage(centres, polys, 0.5).count() and pairs.agg(F.min("share")).first()[0] > 0.2
    want = spatial.zonal_mean(values, polys, weight="w", cover=pairs)
    monkeypatch.setattr(zones, "ROWS", 500)
    monkeypatch.setattr(zones, "SUMS", 300)
    cover = spatial.coverage(centres, polys, 0.5, values=values, weight="w", least=0.2)
    assert "CoGroup" in cover._jdf.queryExecution().optimizedPlan().toString() and "cell_id" not in cover.columns
    _same_means(spatial.zonal_mean(values, polys, weight="w", cover=cover), want)


def test_zonal_mean_without_rows_for_pairs(spark, monkeypatch):
    """The means by a join of all cells and polygons, from tasks that hold a slice of a crowded place."""
    centres, polys, values = _zones(spark, np.random.default_rng(5))
    inside = spatial.points_in_polygons(centres, polys).select("cell_id", "identifier", F.lit(1.0).alias("share"))
    monkeypatch.setattr(zones, "ROWS", 3000)
    monkeypatch.setattr(zones, "SUMS", 1500)
    got = spatial.zonal_mean(values, polys, centres=centres)
    assert "CoGroup" in got._jdf.queryExecution().optimizedPlan().toString()
    _same_means(got, spatial.zonal_mean(values, polys, cover=inside))


def test_nearly_collinear_predictors_keep_their_coefficients(spark):
    """Condition 1e7 of the predictors, far from zero: as a QR of the whole table, in any partitioning."""
    rng = np.random.default_rng(8)
    n = 600
    a = rng.normal(size=n)
    b = a + 1e-7 * rng.normal(size=n)
    frame = pd.DataFrame({"g": np.where(np.arange(n) % 3, "x", None), "a": a + 5, "b": b + 5, "c": rng.normal(size=n) + 100})
    frame["y"] = 3 + 2 * frame["a"] - frame["c"] + 1e6 * (frame["b"] - frame["a"]) + 0.1 * rng.normal(size=n)
    df = spark.createDataFrame(frame).repartition(7)
    got = {(r.g, r.term): r for r in reg.ols(df, ["g"], "y", ["a", "b", "c"]).collect()}
    assert len(got) == 8
    for g, part in frame.groupby(frame["g"].fillna("")):
        x = np.column_stack([np.ones(len(part)), part[["a", "b", "c"]]])
        q, r = np.linalg.qr(x)
        want = np.linalg.solve(r, q.T @ part["y"].to_numpy())
        for term, w in zip(["intercept", "a", "b", "c"], want, strict=True):
            assert got[g or None, term].estimate == pytest.approx(w, rel=1e-6)
        fitted = x @ [got[g or None, t].estimate for t in ["intercept", "a", "b", "c"]]
        assert np.abs(fitted - x @ want).max() < 1e-8 * np.abs(part["y"]).max()
        vifs = [1 / (1 - np.corrcoef(x[:, k], x[:, [0] + [j for j in (1, 2, 3) if j != k]] @ np.linalg.lstsq(x[:, [0] + [j for j in (1, 2, 3) if j != k]], x[:, k], rcond=None)[0])[0, 1] ** 2) for k in (3,)]
        assert got[g or None, "c"].vif == pytest.approx(vifs[0], rel=1e-6) and got[g or None, "b"].vif > 1e12


def test_ranges_are_found_by_halves(spark):
    """A row is not compared with every bound of its series, which would cost rows times ranges; bounds belong to the range before them."""
    t = np.random.default_rng(1).permutation(6000).astype(float)
    df = spark.createDataFrame([("a", float(x) if x else None) for x in t[:4000]] + [(None, float(x)) for x in t[4000:]], "site string, t double")
    placed = ranges.split(df, ["site"], "t", 7)
    assert "filter(_bounds" not in placed._jdf.queryExecution().analyzed().toString()
    got = placed.toPandas().sort_values("t", na_position="first")
    for _, part in got.groupby("site", dropna=False):
        assert part["_range"].iloc[0] == 0 and part["_range"].is_monotonic_increasing
        assert part["_range"].nunique() > 250 and part["_range"].value_counts().max() <= 14


def test_triangles_of_any_parts_agree(spark, monkeypatch):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"g": rng.integers(0, 40, 500), "h": rng.choice(["p", "q"], 500), "a": rng.normal(size=500), "b": rng.normal(size=500) + 9})
    frame.loc[::17, "b"] = np.nan
    df = spark.createDataFrame(frame).replace(float("nan"), None)
    rows = {(r.g, r.h): (r.n, np.reshape(r.r, (3, 3))) for r in factors.factors(df.repartition(5), ["g", "h"], ["a", "b"]).collect()}
    whole = frame.dropna()
    for key, part in whole.groupby(["g", "h"]):
        x = np.column_stack([np.ones(len(part)), part[["a", "b"]]])
        n, r = rows.pop(key)
        assert n == len(part) and np.allclose(r.T @ r, x.T @ x, atol=1e-9)
    assert not rows
    one = factors.factors(df, [], ["a", "b"]).first()
    x = np.column_stack([np.ones(len(whole)), whole[["a", "b"]]])
    assert one.n == len(whole) and np.allclose(np.reshape(one.r, (3, 3)), factors.triangle(x))
    assert factors.factors(df.limit(0), ["g"], ["a"]).count() == 0


@pytest.mark.parametrize("range_rows", [3, 40, 10_000])
def test_long_series_by_ranges(spark, range_rows):
    """Half of the rows on one station: the same values as with one window, whatever the ranges, and no range much longer than asked."""
    rng = np.random.default_rng(6)
    n = 1200
    site = np.where(np.arange(n) % 2 == 0, "hot", rng.choice(["a", "b", "c", None, None, None], n))
    frame = pd.DataFrame({"site": site, "t": rng.permutation(4 * n)[:n], "v": rng.normal(size=n)})
    df = spark.createDataFrame(frame).withColumn("t", F.when(F.col("t") != frame[frame["site"] == "hot"]["t"].iloc[5], F.col("t"))).withColumn("v", F.when(F.col("v") < 2, F.col("v"))).repartition(4)
    for call in (
        lambda r: windows.gap(df, "site", "t", range_rows=r),
        lambda r: windows.shift(df, ["site"], ["t"], "v", 4, range_rows=r),
        lambda r: windows.shift(df, ["site"], ["t"], "v", -5, range_rows=r),
        lambda r: windows.centered_mean(df, ["site"], ["t"], {"v": "m"}, 7, range_rows=r),
    ):
        want, got = ({(x.site, x.t): tuple(x) for x in call(r).collect()} for r in (None, range_rows))
        assert got.keys() == want.keys() and len(got) == n
        for k, x in want.items():
            assert got[k] == pytest.approx(x, abs=1e-12), k
    placed = ranges.split(df, ["site"], "t", range_rows)
    assert (placed is None) == (range_rows > n)
    if placed is not None:
        sizes = [r["count"] for r in placed.groupBy("site", "_range").count().collect()]
        assert max(sizes) <= 2 * range_rows and sum(sizes) == n
        few = ranges.borders(checkpoint_table(placed), ["site"], "t", 2, 3)
        assert few.count() <= 5 * len(sizes)


def test_state_of_periods_is_one_pass_over_all_rows(spark, tmp_path):
    """Added, corrected, emptied and null periods; an update reads its own periods only and may be repeated."""
    rng = np.random.default_rng(4)
    n = 900
    frame = pd.DataFrame({"g": rng.choice(["p", "q", None], n), "year": rng.integers(2000, 2006, n), "a": rng.normal(size=n) + 50})
    frame["b"] = frame["a"] + 1e-5 * rng.normal(size=n)
    frame["y"] = 1 + 2 * frame["a"] - 3 * frame["b"] + rng.normal(size=n)
    df = spark.createDataFrame(frame).withColumn("year", F.when(F.col("year") < 2005, F.col("year").cast("int")))
    source, path, cols = str(tmp_path / "rows"), str(tmp_path / "state"), ["y", "a", "b"]
    df.write.partitionBy("year").parquet(source)
    rows = spark.read.parquet(source)
    stored = lambda: state.read(spark, path, "g string", "year", "int")
    assert stored().count() == 0

    def agree(want):
        got = {(r.g, r.term): r for r in reg.ols_of(state.merged(stored(), ["g"]), ["g"], "y", ["a", "b"]).collect()}
        full = {(r.g, r.term): r for r in reg.ols(want, ["g"], "y", ["a", "b"]).collect()}
        assert got.keys() == full.keys() and got
        for k, r in full.items():
            assert got[k].n == r.n and got[k].estimate == pytest.approx(r.estimate, rel=1e-6) and got[k].p_value == pytest.approx(r.p_value, rel=1e-5, abs=1e-12)

    state.update(path, rows.where("year < 2003"), ["g"], "year", cols)
    agree(rows.where("year < 2003"))
    wrong = rows.withColumn("y", F.col("y") * 2 + F.col("a") ** 2)
    state.update(path, wrong, ["g"], "year", cols, [2003, 2004, None])
    agree(rows.where("year < 2003").unionByName(wrong.where("year >= 2003 or year is null")))
    for _ in range(2):
        state.update(path, rows, ["g"], "year", cols, [2003, 2004, None])
        agree(rows)
    state.update(path, rows.where("year <> 2001"), ["g"], "year", cols, [2001])
    agree(rows.where("year <> 2001 or year is null"))
    agree_part = {r.g: r for r in state.moments(state.merged(stored().where("year = 2002"), ["g"]), ["g"], 3).collect()}
    for r in aggregates.gram(rows.where("year = 2002"), ["g"], cols).collect():
        assert agree_part[r.g].n == r.n and agree_part[r.g].mean == pytest.approx(r.mean) and agree_part[r.g]["cov"] == pytest.approx(r["cov"], rel=1e-9)
    assert reg.backward_of(state.merged(stored(), ["g"]), ["g"], "y", ["a", "b"]).count() == 3
    scan = state.of_periods(rows, "year", [2003])
    assert {p.rsplit("/", 2)[-2] for p in scan.inputFiles()} >= {"year=2003"}
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "year" in plan.split("PartitionFilters: [")[1].split("]")[0] and "2003" in plan.split("PartitionFilters: [")[1].split("]")[0]


@pytest.mark.parametrize(("dims", "part"), [(2, 7), (6, 1000)])
def test_dunn_without_comparing_all_rows(spark, dims, part):
    """Clustered rows with ties, copies, a cluster of one row and rows without a cluster."""
    rng = np.random.default_rng(dims)
    middle = rng.uniform(-20, 20, (5, dims))
    label = rng.integers(0, 5, 1500)
    vec = np.round(middle[label] + rng.normal(scale=0.5, size=(1500, dims)), 2)
    rows = [(i, [float(x) for x in v], int(k)) for i, (v, k) in enumerate(zip(vec, label, strict=True))]
    rows += [(2000, [99.0] * dims, 9), (2001, [0.0] * dims, None), (2002, None, 1)]
    df = spark.createDataFrame(rows, "id long, v array<double>, k int")
    found, compared = extremes.extremes(df, "id", "v", "k", part)
    got = found.first()
    assert found.count() == 1 and compared < 0.2
    d = np.sqrt(((vec[:, None] - vec) ** 2).sum(-1))
    same = label[:, None] == label
    lone = np.sqrt(((vec - 99.0) ** 2).sum(1)).min()
    assert got.between == pytest.approx(min(d[~same].min(), lone), rel=1e-7) and got.within == pytest.approx(d[same].max(), rel=1e-7)
    one = df.where("k = 9")
    assert regions.dunn(one, "id", "v", "k").first() == (None, 0.0, None) and regions.dunn(df.limit(0), "id", "v", "k").first() == (None, None, None)
    assert regions.dunn(df, "id", "v", "k", compared=True).first().compared == pytest.approx(compared)


def test_extremes_of_rows_that_prune_nothing(spark, monkeypatch):
    """Labels without any place: plain blocks are compared, which send each row a few times only; one pass serves several clusterings."""
    rng = np.random.default_rng(8)
    vec, label = rng.normal(size=(2500, 12)), rng.integers(0, 6, 2500)
    rows = [(i, [float(x) for x in v], int(k)) for i, (v, k) in enumerate(zip(vec, label, strict=True))]
    df = spark.createDataFrame([*rows, (3000, [0.0] * 12, None), (3001, None, 1)], "id long, v array<double>, k int")
    assert extremes.extremes(df, "id", "v", "k", few=0) is None and extremes.extremes(df, "id", "v", "k") is not None
    d = np.sqrt(((vec[:, None] - vec) ** 2).sum(-1))
    same = label[:, None] == label
    pruned = regions.dunn(df, "id", "v", "k").first()
    monkeypatch.setattr(extremes, "FEW", 0)
    got = regions.dunn(df, "id", "v", "k", compared=True).first()
    assert got.compared == 1 and (got.separation, got.diameter) == pytest.approx((d[~same].min(), d[same].max()))
    assert got[:3] == pytest.approx(pruned[:3])
    both = regions._extremes(df.withColumn("one", F.lit(1)), "id", "v", {3: "k", 7: "one"}).collect()
    both = {r.clusters: r for r in both}
    assert both[3].separation == pytest.approx(got.separation) and both[3].diameter == pytest.approx(got.diameter)
    assert both[7].separation is None and both[7].diameter >= d.max()
    cols = [F.col("v")[i].alias(f"c{i}") for i in range(12)]
    wide = df.where("k is not null and v is not null").select("id", *cols)
    names = [f"c{i}" for i in range(12)]
    plain = {r.clusters: r.dunn for r in regions.validity_sweep(wide, "id", names, [2, 3], 2).collect()}
    monkeypatch.undo()
    assert plain == pytest.approx({r.clusters: r.dunn for r in regions.validity_sweep(wide, "id", names, [2, 3], 2).collect()}) and set(plain) == {2, 3}


def test_pairs_within(cloud):
    pdf, df = cloud
    some = df.filter("id < 60")
    got = {(r.id_a, r.id_b) for r in pairs.pairs_within(some, "id", "x", "y", 0.5).collect()}
    want = {
        (i, j) for i, j in itertools.combinations(range(60), 2) if np.hypot(pdf.x[i] - pdf.x[j], pdf.y[i] - pdf.y[j]) <= 0.5
    }
    assert got == want


def test_pairs_within_crowded_tiles(cloud, monkeypatch):
    """Tiles cut into slices, negative tiles, repeated and missing ids; the work is dealt over all shuffle partitions."""
    pdf, df = cloud
    spark = df.sparkSession
    monkeypatch.setattr(pairs, "TILE_ROWS", 7)
    rows = [(i, float(a) - 0.5, float(b) - 0.5) for i, a, b in zip(pdf.id, pdf.x, pdf.y, strict=True)] + [(3, 0.0, 0.0), (None, 0.0, 0.0), (900, None, 0.0)]
    some = spark.createDataFrame(rows, "id long, x double, y double")
    found = pairs.pairs_within(some, "id", "x", "y", 0.4)
    got = sorted((r.id_a, r.id_b, round(r.distance, 9)) for r in found.collect())
    whole = [r for r in rows if None not in r]
    want = [(min(a[0], b[0]), max(a[0], b[0]), round(float(np.hypot(a[1] - b[1], a[2] - b[2])), 9)) for a, b in itertools.combinations(whole, 2) if a[0] != b[0] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 0.4 * 0.4]
    assert got == sorted(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_pairs_without_a_radius(cloud, monkeypatch):
    """All pairs, however far apart, also of rows without a place; the blocks are dealt over all shuffle partitions."""
    pdf, df = cloud
    spark = df.sparkSession
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 13)
    rows = [(i, float(a), float(b)) for i, a, b in zip(pdf.id[:80], pdf.x[:80], pdf.y[:80], strict=True)] + [(3, 9e6, 0.0), (None, 0.0, 0.0), (900, None, 0.0)]
    found = pairs.pairs_within(spark.createDataFrame(rows, "id long, x double, y double"), "id", "x", "y")
    got = collections.Counter((r.id_a, r.id_b, None if r.distance is None else round(r.distance, 6)) for r in found.collect())
    some = [r for r in rows if r[0] is not None]
    assert got == collections.Counter(
        (min(a[0], b[0]), max(a[0], b[0]), None if None in (*a, *b) else round(float(np.hypot(a[1] - b[1], a[2] - b[2])), 6)) for a, b in itertools.combinations(some, 2) if a[0] != b[0]
    )
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_jn_pairwise_lists_every_pair(spark, tmp_path):
    """Points on both coasts are a pair as well."""
    from hydropanel.plans import catalog

    spark.createDataFrame([(k, 1.0 * k) for k in (1, 2, 3, 4000, 700)], "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = catalog.QUERIES["jn_pairwise"](spark, str(tmp_path)).collect()
    assert sorted((r.id_a, r.id_b) for r in got) == sorted(itertools.combinations((1, 2, 3, 700, 4000), 2)) and max(r.km for r in got) > 1000


def test_release_deletes_the_written_stages(spark, monkeypatch):
    monkeypatch.setattr(session, "_stages", [])
    checkpoint_table(spark.range(3)).count()
    path = session._stages[0]
    assert os.path.isdir(path)
    session.release(spark)
    assert not os.path.exists(path) and not session._stages


def test_rows_sent_to_pair_tasks_grow_with_the_rows(spark):
    def sent(n: int) -> int:
        def count(same, a, b):
            return pd.DataFrame({"n": [len(a) + (0 if same else len(b))]})

        return pairs.blocked_pairs(spark.range(n), F.col("id"), count, "n long").agg(F.sum("n")).first()[0]

    assert sent(20_000) <= 4.5 * sent(5_000)


def test_polygons_with_parts_and_holes(spark):
    def square(x, y, r):
        return [(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r)]

    polys = spark.createDataFrame(
        [("p", [square(0.0, 0.0, 2.0), square(0.0, 0.0, 1.0), square(5.0, 0.0, 1.0)])],
        "identifier string, ring array<array<struct<lon:double,lat:double>>>",
    )
    points = spark.createDataFrame([(1, 0.1, 0.1), (2, 1.5, 0.0), (3, 5.2, 0.3), (4, 3.0, 0.0)], "cell_id int, lon double, lat double")
    assert {r.cell_id for r in spatial.points_in_polygons(points, polys).collect()} == {2, 3}
    # a cell with its left half in the hole
    cell = spark.createDataFrame([(9, 1.0, 0.0, 8.0), (2, 1.5, 0.0, 2.0)], "cell_id int, lon double, lat double, value double")
    cover = spatial.coverage(cell, polys, size=0.4, sub=4)
    assert {r.cell_id: r.share for r in cover.collect()} == {9: 0.5, 2: 1.0}
    got = spatial.zonal_mean(cell, polys, keys=(), cover=cover).first()
    assert got["mean"] == pytest.approx((8 * 0.5 + 2) / 1.5) and got.n_cells == 2
    grid = spatial.square_grid(points, "lon", "lat", 1.0, bbox=(0, 0, 2.5, 1.5))
    assert grid.count() == 6 and grid.agg(F.max("x"), F.max("y")).first() == (2.5, 1.5)


def test_kmeans_and_lloyd(spark):
    rng = np.random.default_rng(0)
    centres = np.array([[0, 0], [10, 0], [0, 10]])
    pts = np.vstack([c + rng.normal(scale=0.3, size=(30, 2)) for c in centres])
    df = spark.createDataFrame([(i, float(a), float(b), int(i // 30)) for i, (a, b) in enumerate(pts)], "id int, a double, b double, truth int")
    got = regions.kmeans(df, "id", ["a", "b"], k=3).toPandas().set_index("id").cluster
    first = sorted(range(90), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[:3]
    at = pts[first]
    for _ in range(25):
        label = np.argmin(((pts[:, None] - at) ** 2).sum(axis=2), axis=1)
        at = np.array([pts[label == c].mean(axis=0) if (label == c).any() else at[c] for c in range(3)])
    label = np.argmin(((pts[:, None] - at) ** 2).sum(axis=2), axis=1)
    assert [got[i] - 1 for i in range(90)] == list(label)
    again = regions.kmeans(df.repartition(5), "id", ["a", "b"], k=3).toPandas().set_index("id").cluster
    assert got.sort_index().equals(again.sort_index())
    assert regions.kmeans(df.limit(0), "id", ["a", "b"], k=3).count() == 0
    vec = df.withColumn("v", F.array("a", "b"))
    means = regions.mean_vectors(vec, "truth", "v")
    near = regions.assign(vec, "v", means, "truth").toPandas()
    assert (near.nearest == near.truth).all()
    step = {r.truth: r.centre for r in regions.lloyd_step(vec, "v", means, "truth").collect()}
    assert all(step[r.truth] == pytest.approx(r.centre) for r in means.collect())


def test_centroid_of_near_members(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (1, 2.0, 0.0), (1, 100.0, 0.0)], "c int, x double, y double")
    got = {r.x: r for r in regions.centroids(df, "c", "x", "y", 35).collect()}
    assert got[0.0].cen_x == 34.0 and got[0.0].cen_x2 == 1.0 and got[100.0].cen_x2 is None


def test_regressions_keep_every_group(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g, n in (("full", 40), ("collinear", 40), ("short", 2)):
        a, b = rng.normal(size=n), rng.normal(size=n)
        b = 2 * a + 1 if g == "collinear" else b
        rows += [(g, float(y), float(x1), float(x2)) for y, x1, x2 in zip(a + rng.normal(size=n), a, b, strict=True)]
    df = spark.createDataFrame(rows, "g string, y double, a double, b double")
    fits = {(r.g, r.term): r for r in reg.ols(df, ["g"], "y", ["a", "b"]).collect()}
    assert len(fits) == 9 and fits["collinear", "b"].estimate is None and fits["collinear", "a"].estimate is not None
    assert fits["short", "a"].estimate is None and fits["short", "a"].n == 2
    left = {r.g: r for r in reg.backward(df, ["g"], "y", ["a", "b"]).collect()}
    assert set(left) == {"full", "collinear", "short"} and left["collinear"].b_coeff is None
    retained = spark.createDataFrame([("full", "a")], "g string, term string")
    families = {"one": ["a"], "two": ["b"]}
    parts = reg.partial_models(df, ["g"], "y", families, retained)
    assert {r.g: r.a is None for r in parts.collect()} == {"full": False, "collinear": True, "short": True}
    modelled = reg.predict_parts(df, parts, ["g"], families, ["g", "y"])
    assert modelled.count() == len(rows) and {r.full_model for r in modelled.filter("g = 'short'").collect()} == {0.0}


def _within(pts, label):
    return sum(((pts[label == c] - pts[label == c].mean(axis=0)) ** 2).sum() for c in set(label))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_exchange_ends_where_no_row_gains(spark, seed):
    rng = np.random.default_rng(seed)
    pts = rng.normal(size=(150, 3)) * [1, 2, 0.5] + rng.integers(0, 3, size=(150, 1))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "id int, a double, b double, c double")
    labels = lambda out: np.array([r["cluster"] for r in out.orderBy("id").collect()])
    before = labels(regions.kmeans(df, "id", ["a", "b", "c"], k=6, max_iter=3))
    after = labels(transfer.kmeans(df, "id", ["a", "b", "c"], k=6, max_iter=3))
    assert _within(pts, after) < _within(pts, before)
    size, centre = np.bincount(after, minlength=7)[1:], np.array([pts[after == c].mean(axis=0) for c in range(1, 7)])
    for p, a in zip(pts, after - 1, strict=True):
        d = ((p - centre) ** 2).sum(axis=1)
        if size[a] > 1:
            into = np.delete(size / (size + 1) * d, a)
            assert size[a] / (size[a] - 1) * d[a] <= into.min() + 1e-9
    again = labels(transfer.kmeans(df.repartition(5), "id", ["a", "b", "c"], k=6, max_iter=3))
    assert abs(_within(pts, again) - _within(pts, after)) < 1e-9


def test_exchange_keeps_optimal_labels_and_compares_few_rows(spark):
    rng = np.random.default_rng(0)
    corners = np.array([[0, 0], [10, 0], [0, 10]])
    pts = np.vstack([c + rng.normal(scale=0.8, size=(300, 2)) for c in corners])
    df = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(pts)], "id int, v array<double>")
    # two rows start on the wrong side of a centre that lies far out
    trace = []
    out = transfer.exchange(df, "id", "v", [[0.0, 0.0], [9.0, 1.0], [0.0, 25.0]], trace=trace)
    label = np.array([r["label"] for r in out.orderBy("id").collect()])
    assert all(len(set(label[k : k + 300])) == 1 for k in (0, 300, 600)) and len(set(label)) == 3
    sums = [s for _, s in trace]
    assert all(b < a for a, b in zip(sums, sums[1:], strict=False)) and abs(sums[-1] - _within(pts, label)) < 1e-6 * sums[-1]
    # a few rows between two clusters change sides, the others are settled by their bounds after the first round
    between = [(900 + i, [0.25 * i, 0.0]) for i in range(41)]
    trace = []
    transfer.exchange(df.union(spark.createDataFrame(between, df.schema)), "id", "v", [[2.5, 0.0], [10.0, 0.0], [0.0, 10.0]], trace=trace).count()
    assert len(trace) > 1 and trace[0][0] == 941 and all(compared < 0.1 * 941 for compared, _ in trace[1:]), trace
    wide = df.select("id", F.col("v")[0].alias("a"), F.col("v")[1].alias("b"))
    lloyd = regions.kmeans(wide, "id", ["a", "b"], k=3)
    assert not transfer.kmeans(wide, "id", ["a", "b"], k=3).exceptAll(lloyd).count()
    assert transfer.kmeans(wide.limit(0), "id", ["a", "b"], k=3).count() == 0
    assert {r["cluster"] for r in transfer.kmeans(wide.limit(5), "id", ["a", "b"], k=1).collect()} == {1}


def test_streamed_groups_are_sorted_and_never_held(spark):
    rows = 600_000
    df = spark.range(rows).select(F.when(F.col("id") % 3 == 0, "small").otherwise("large").alias("g"), F.hash("id").alias("t"), F.lit("x" * 200).alias("pad"))

    def walk(key, batches):
        n, most, last, ordered = 0, 0, None, True
        for batch in batches:
            t = batch.column("t").to_numpy()
            ordered &= bool((np.diff(t.astype(np.int64)) >= 0).all()) and (last is None or last <= t[0])
            n, most, last = n + len(t), max(most, len(t)), t[-1]
        yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([n]), pa.array([most]), pa.array([ordered])], names=["g", "n", "most", "ordered"])

    out = apply.group_stream(df, ["g"], walk, "g string, n long, most long, ordered boolean", order=["t"])
    got = {r["g"]: r for r in out.collect()}
    limit = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    assert got["large"]["n"] == 2 * got["small"]["n"] == 400_000
    assert all(r["ordered"] and r["most"] <= limit for r in got.values())
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1
    assert apply.group_stream(df.limit(0), ["g"], walk, "g string, n long, most long, ordered boolean").count() == 0
