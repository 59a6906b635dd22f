"""Polygon averages, grids, variograms, kriging."""

from pyspark.sql import functions as F

from hydropanel.functions import geo
from hydropanel.operators import reshape, seasonal, spatial
from hydropanel.plans import oracle
from hydropanel.plans.registry import query

SIZE = 50_000.0


@query(
    "sp_zonal_mean",
    """SELECT identifier, time, avg(value) AS mean, count(value) AS n_cells FROM cells JOIN inside ON cell_id = point_id
      GROUP BY identifier, time""",
    "mean",
)
def sp_zonal_mean(p):
    centres = p.points.select(F.col("point_id").alias("cell_id"), "lon", "lat")
    return spatial.zonal_mean(p.values, p.watersheds, centres=centres)


@query(
    "sp_zonal_weighted",
    """SELECT identifier, sum(value * w) / sum(w) AS mean, count(value) AS n_cells FROM (
      SELECT *, cos(radians(lat)) AS w FROM cells) JOIN inside ON cell_id = point_id GROUP BY identifier""",
    "mean",
)
def sp_zonal_weighted(p):
    """Cells weighted by their area on the sphere, over the whole period."""
    cells = p.cells.withColumn("w", F.cos(F.radians("lat")))
    return spatial.zonal_mean(cells, p.watersheds, keys=(), weight="w")


_COVER = {
    "cover_points": """SELECT point_id, lon + dx AS lon, lat + dy AS lat FROM (SELECT point_id, lon, lat FROM points),
      (VALUES (-0.125::DOUBLE, -0.125::DOUBLE), (-0.125, 0.125), (0.125, -0.125), (0.125, 0.125)) o(dx, dy)""",
    "cover_inside": """SELECT point_id, lon, lat, identifier FROM cover_points, basin_edges
      WHERE (y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1) GROUP BY ALL HAVING count(*) % 2 = 1""",
    "cover_share": "SELECT point_id AS cell_id, identifier, count(*) / 4 AS share FROM cover_inside GROUP BY 1, 2",
}


@query(
    "sp_zonal_cover",
    """SELECT identifier, time, sum(value * share) / sum(share) AS mean, count(value) AS n_cells
      FROM (SELECT site_number AS identifier FROM site) LEFT JOIN (SELECT * FROM cells JOIN cover_share USING (cell_id)) USING (identifier)
      GROUP BY identifier, time""",
    "mean",
    _COVER,
)
def sp_zonal_cover(p):
    """Half-degree cells counted by their share in polygons with a hole and a second part."""
    centres = p.points.select(F.col("point_id").alias("cell_id"), "lon", "lat")
    return spatial.zonal_mean(p.values, p.basins, cover=spatial.coverage(centres, p.basins, size=0.5, sub=2, values=p.values))


# The area of a ring in a square, as the sum over its edges of the integral along latitude of the distance to the square's left side.
_AREA = {
    "cut_pairs": """SELECT point_id AS cell_id, identifier, r, x1, y1, x2, y2, lon - 0.25::DOUBLE AS a, lon + 0.25::DOUBLE AS b,
      greatest(least(y1, y2), lat - 0.25::DOUBLE) AS lo, least(greatest(y1, y2), lat + 0.25::DOUBLE) AS hi FROM points, ring_edges WHERE lon BETWEEN mx - 6 AND mx + 6 AND lat BETWEEN my - 6 AND my + 6""",
    "cut_spans": """SELECT *, least(u, v) AS p, greatest(u, v) AS q FROM (SELECT *, x1 + (lo - y1) * (x2 - x1) / (y2 - y1) AS u, x1 + (hi - y1) * (x2 - x1) / (y2 - y1) AS v FROM cut_pairs WHERE hi > lo)""",
    "cut_edges": """SELECT cell_id, identifier, r, sign(y2 - y1) * (hi - lo) * CASE WHEN q - p < CAST(1e-12 AS DOUBLE) THEN least(greatest(p, a), b) - a ELSE
      ((greatest(least(q, b), a) - a) ** 2 - (greatest(least(p, b), a) - a) ** 2 + 2 * (b - a) * (greatest(q, b) - greatest(p, b))) / (2 * (q - p)) END AS part FROM cut_spans""",
    "cut_share": """SELECT cell_id, identifier, sum(CASE WHEN r = 1 THEN -1 ELSE 1 END * abs(area)) / (0.5::DOUBLE * 0.5) AS share
      FROM (SELECT cell_id, identifier, r, sum(part) AS area FROM cut_edges GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING share > CAST(1e-9 AS DOUBLE)""",
}


@query("sp_clip_share", "SELECT cell_id, identifier, share, share AS piece_share FROM cut_share", "share piece_share", _AREA)
def sp_clip_share(p):
    """Half-degree cells cut by polygons with a hole and a second part: the share of each cell, and the same from the pieces."""
    cells = p.points.select(F.col("point_id").alias("cell_id"), "lon", "lat")
    cut = spatial.clip(cells, p.basins, size=0.5, keep=["identifier"])
    pieces = F.aggregate("pieces", F.lit(0.0), lambda total, piece: total + geo.ring_area(piece)) / 0.25
    return cut.select("cell_id", "identifier", (F.col("area") / 0.25).alias("share"), pieces.alias("piece_share")).where("share > 1e-9")


@query(
    "sp_zonal_area",
    """SELECT identifier, time, sum(value * share) / sum(share) AS mean, count(value) AS n_cells
      FROM (SELECT site_number AS identifier FROM site) LEFT JOIN (SELECT * FROM cells JOIN cut_share USING (cell_id)) USING (identifier)
      GROUP BY identifier, time""",
    "mean",
    _AREA,
)
def sp_zonal_area(p):
    """Half-degree cells counted by the area of their cut with the polygons."""
    centres = p.points.select(F.col("point_id").alias("cell_id"), "lon", "lat")
    cover = spatial.coverage(centres, p.basins, size=0.5, values=p.values, least=1e-9)
    return spatial.zonal_mean(p.values, p.basins, cover=cover)


def _months(p):
    return p.panel_month.withColumn("date", F.make_date("cal_year", "month", F.lit(1)))


@query(
    "sp_water_year_total",
    f"SELECT site_number, year, sum(precip_m * ({oracle.DAYS}) * CAST(0.001 AS DOUBLE)) AS total FROM panel_month GROUP BY 1, 2",
    "total",
)
def sp_water_year_total(p):
    return seasonal.water_year_total(_months(p), "site_number", "date", "precip_m")


@query("sp_water_year_mean", "SELECT site_number, year, avg(temp_k) AS mean FROM panel_month GROUP BY 1, 2", "mean")
def sp_water_year_mean(p):
    return seasonal.water_year_mean(_months(p), "site_number", "date", "temp_k")


_SEASON_TOTAL = f"""SELECT site_number, season, CASE WHEN season = 'SON' THEN cal_year ELSE year END AS season_year,
  sum(precip_m * ({oracle.DAYS}) * CAST(0.001 AS DOUBLE)) AS total FROM panel_month GROUP BY 1, 2, 3"""
_YEARS = range(1995, 2003)
_SEASON_COLS = [f"{s}_{y}" for s in ("DJF", "MAM", "JJA", "SON") for y in _YEARS]


@query(
    "sp_season_total",
    "SELECT site_number, "
    + ", ".join(f"max(total) FILTER (season || '_' || season_year = '{c}') AS {c}" for c in _SEASON_COLS)
    + f" FROM ({_SEASON_TOTAL}) GROUP BY site_number",
    _SEASON_COLS,
)
def sp_season_total(p):
    return seasonal.season_total(_months(p), "site_number", "date", "precip_m", years=_YEARS)


@query("sp_season_total_long", _SEASON_TOTAL, "total")
def sp_season_total_long(p):
    return seasonal.season_total(_months(p), "site_number", "date", "precip_m")


@query(
    "sp_agency_stack",
    """SELECT site_number, year, CASE WHEN length(site_number) < 2 THEN precip_m END AS precip_m, temp_k FROM panel_year""",
    "precip_m temp_k",
)
def sp_agency_stack(p):
    """One agency delivers precipitation and temperature, the other only temperature."""
    short = F.length("site_number") < 2
    year = p.stage("panel_year")
    a = year.filter(short).select("site_number", "year", "precip_m", "temp_k")
    b = year.filter(~short).select("site_number", "year", "temp_k")
    return reshape.stack([a, b], fill=True)


@query("sp_site_mean", "SELECT site_number, lon, lat, avg(runoff_ratio) AS site_runoff FROM panel_year GROUP BY 1, 2, 3", "lon lat site_runoff")
def sp_site_mean(p):
    return spatial.site_points(p.panel_year, ["site_number", "lon", "lat"], "runoff_ratio", "site_runoff")


@query("sp_project", "SELECT point_id, x, y, lon AS lon_back, lat AS lat_back FROM points", "x y lon_back lat_back", digits=4)
def sp_project(p):
    lon, lat = geo.from_albers("x", "y")
    return p.points.select("point_id", "x", "y", lon.alias("lon_back"), lat.alias("lat_back"))


_GRID = {
    "extent": "SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points",
    "grid_cells": f"""SELECT ix, iy, x0 + (ix + CAST(0.5 AS DOUBLE)) * {SIZE!r}::DOUBLE AS x, y0 + (iy + CAST(0.5 AS DOUBLE)) * {SIZE!r}::DOUBLE AS y FROM extent,
      LATERAL (SELECT unnest(range(CAST(floor((x1 - x0) / {SIZE!r}::DOUBLE) AS BIGINT) + 1)) AS ix) a,
      LATERAL (SELECT unnest(range(CAST(floor((y1 - y0) / {SIZE!r}::DOUBLE) AS BIGINT) + 1)) AS iy) b""",
}


@query("sp_grid", "SELECT * FROM grid_cells", "x y", _GRID, digits=3)
def sp_grid(p):
    return spatial.square_grid(p.points, "x", "y", SIZE)


_VARIOGRAM = {
    "reach": "SELECT sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2) / 3 AS cutoff, var_samp(value) AS v FROM points",
    "binned": """SELECT CAST(ceil(d / (cutoff / 15)) AS INTEGER) AS bin, d, dz, cutoff, v FROM (
      SELECT sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, a.value - b.value AS dz, cutoff, v
      FROM points a JOIN points b ON a.point_id < b.point_id, reach) WHERE d > 0 AND d <= cutoff""",
    "vario": """SELECT bin, count(*) AS np, avg(d) AS dist, sum(dz * dz) / (2 * count(*)) / max(v) AS gamma, max(cutoff) AS cutoff
      FROM binned GROUP BY bin""",
}


@query("sp_variogram", "SELECT bin, np, dist / 1000 AS km, gamma FROM vario", "km gamma", _VARIOGRAM)
def sp_variogram(p):
    vg = spatial.variogram(p.points, "x", "y", "value")
    return vg.select("bin", "np", (F.col("dist") / 1000).alias("km"), "gamma")


# Values with a spatial pattern, so that the fit has a range to find.
_PATTERN = "sin(x / 400000) + cos(y / 400000)"


def _fit_round(name: str, ranges: str) -> dict[str, str]:
    """One round of the fit in SQL: the error of every range tried, and the best of each model."""
    return {
        f"{name}_f": f"""SELECT kind, range, np / (dist * dist) AS w, gamma AS g, CASE kind WHEN 'Exp' THEN 1 - exp(-dist / range)
          ELSE 1.5 * least(dist / range, 1) - 0.5 * least(dist / range, 1) ** 3 END AS f FROM svario, ({ranges})""",
        f"{name}_s": f"""SELECT kind, range, sum(w) AS S, sum(w * f) AS P, sum(w * f * f) AS PP, sum(w * g) AS G, sum(w * f * g) AS PG, sum(w * g * g) AS GG
          FROM {name}_f GROUP BY 1, 2""",
        f"{name}_c": f"""SELECT *, (S * PG - P * G) / (S * PP - P * P) AS b, (G - (S * PG - P * G) / (S * PP - P * P) * P) / S AS a
          FROM {name}_s WHERE S * PP - P * P > CAST(1e-12 AS DOUBLE) * S * PP""",
        f"{name}_e": f"""SELECT kind, range, nugget, psill, round((GG - 2 * nugget * G - 2 * psill * PG + nugget * nugget * S + 2 * nugget * psill * P + psill * psill * PP) / GG, 12) AS e
          FROM (SELECT *, CASE WHEN b < 0 THEN 0 WHEN a < 0 THEN PG / PP ELSE b END AS psill, CASE WHEN b < 0 THEN G / S WHEN a < 0 THEN 0 ELSE a END AS nugget FROM {name}_c)""",
    }


_BEST = "SELECT kind, max(cutoff) AS cutoff, min_by(range, (e, range)) AS best FROM {0}_e, (SELECT max(cutoff) AS cutoff FROM svario) GROUP BY kind"


def _fit_sql(value: str) -> dict[str, str]:
    """The variogram of a value and all rounds of its fit."""
    return (
        {
            "spoints": f"SELECT point_id, x, y, {value} AS value FROM points",
            "sreach": "SELECT sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2) / 3 AS cutoff, var_samp(value) AS v FROM spoints",
            "sbinned": """SELECT CAST(ceil(d / (cutoff / 15)) AS INTEGER) AS bin, d, dz, cutoff, v FROM (
              SELECT sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, a.value - b.value AS dz, cutoff, v
              FROM spoints a JOIN spoints b ON a.point_id < b.point_id, sreach) WHERE d > 0 AND d <= cutoff""",
            "svario": "SELECT bin, count(*) AS np, avg(d) AS dist, sum(dz * dz) / (2 * count(*)) / max(v) AS gamma, max(cutoff) AS cutoff FROM sbinned GROUP BY bin",
        }
        | _fit_round(
            "r0",
            """SELECT kind, (SELECT max(cutoff) FROM svario) * 10.0 ** (k / 20.0::DOUBLE) AS range
              FROM (SELECT unnest(range(-60, 61)) AS k), (SELECT unnest(['Exp', 'Sph']) AS kind)""",
        )
        | {
            k: v
            for n in (1, 2, 3)
            for k, v in _fit_round(
                f"r{n}", f"SELECT kind, best * 10.0 ** (k / 20.0::DOUBLE / {10**n}) AS range FROM ({_BEST.format(f'r{n - 1}')}), (SELECT unnest(range(-10, 11)) AS k)"
            ).items()
        }
    )


_FITTED = "SELECT kind, range / 1000 AS range_km, nugget, psill FROM r3_e ORDER BY e, kind, range LIMIT 1"


def _fitted(points):
    fit = spatial.fit_variogram(spatial.variogram(points, "x", "y", "value"))
    return fit.select("kind", (F.col("range") / 1000).alias("range_km"), "nugget", "psill")


@query("sp_variogram_fit", _FITTED, "range_km nugget psill", _fit_sql("value"), digits=4)
def sp_variogram_fit(p):
    return _fitted(p.points)


@query("sp_variogram_fit_pattern", _FITTED, "range_km nugget psill", _fit_sql(_PATTERN), digits=4)
def sp_variogram_fit_pattern(p):
    """The same for values with a spatial pattern at the points."""
    return _fitted(p.points.withColumn("value", F.expr(_PATTERN)))


@query(
    "sp_krige_nugget",
    """SELECT ix, iy, avg(value) AS prediction, 0.5::DOUBLE * (1 + 1 / nullif(count(value), 0)) AS variance
      FROM grid_cells g LEFT JOIN points p ON (g.x - p.x) ** 2 + (g.y - p.y) ** 2 <= 300000.0 ** 2 GROUP BY ix, iy""",
    "prediction variance",
    _GRID,
)
def sp_krige_nugget(p):
    """Kriging without spatial dependence has a closed form: the mean of the stations in reach."""
    model = p.points.select(F.lit("Exp").alias("kind"), F.lit(1000.0).alias("range"), F.lit(0.5).alias("nugget"), F.lit(0.0).alias("psill")).limit(1)
    return spatial.krige(p.points, spatial.square_grid(p.points, "x", "y", SIZE), model, "x", "y", "value")


@query("sp_krige")
def sp_krige(p):
    """A dense solve per grid cell: not for SQL, tested against brute force."""
    pts = p.points.select("x", "y", "value")
    model = spatial.fit_variogram(spatial.variogram(pts, "x", "y", "value"))
    return spatial.krige(pts, spatial.square_grid(pts, "x", "y", SIZE), model, "x", "y", "value")


@query(
    "sp_clip",
    """SELECT DISTINCT ix, iy FROM clip_cells, edges WHERE (y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1)
      GROUP BY ix, iy, identifier HAVING count(*) % 2 = 1""",
    more={
        "clip_cells": """SELECT ix, iy, x0 + (ix + CAST(0.5 AS DOUBLE)) / 4 AS lon, y0 + (iy + CAST(0.5 AS DOUBLE)) / 4 AS lat FROM (
          SELECT min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM points),
          LATERAL (SELECT unnest(range(CAST(floor((x1 - x0) / 0.25::DOUBLE) AS BIGINT) + 1)) AS ix) a,
          LATERAL (SELECT unnest(range(CAST(floor((y1 - y0) / 0.25::DOUBLE) AS BIGINT) + 1)) AS iy) b"""
    },
)
def sp_clip(p):
    """A quarter-degree grid, cut to the watersheds."""
    grid = spatial.square_grid(p.points, "lon", "lat", 0.25).withColumnsRenamed({"x": "lon", "y": "lat"})
    return spatial.clip(grid, p.watersheds).select("ix", "iy")
