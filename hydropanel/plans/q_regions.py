"""Flow regimes and hydro-regions."""

from pyspark.sql import functions as F

from hydropanel.operators import regions, transfer
from hydropanel.operators.reshape import MONTH_NAMES
from hydropanel.plans.registry import query

COLS = [*MONTH_NAMES, "lon", "lat", "elev"]

_SHARE = """SELECT site_number, month, avg(share) AS share FROM (
  SELECT site_number, year, month, max(q) / max(max(q)) OVER (PARTITION BY site_number, year) AS share FROM (
  SELECT site_number, CAST(year(date) + CASE WHEN month(date) > 9 THEN 1 ELSE 0 END AS INTEGER) AS year, month(date) AS month,
    q_cfs * CAST(0.028316846592 AS DOUBLE) AS q FROM obs WHERE q_cfs > 0) GROUP BY 1, 2, 3) GROUP BY 1, 2"""
_REGIME = {
    "regimes": "SELECT site_number, "
    + ", ".join(f"max(share) FILTER (month = {m}) AS {n}" for m, n in enumerate(MONTH_NAMES, 1))
    + f" FROM ({_SHARE}) GROUP BY site_number"
}
_FEATURES = _REGIME | {
    "station_features": f"""SELECT site_number, {', '.join(COLS)} FROM regimes JOIN (SELECT site_number, lon, lat, elev FROM site) USING (site_number)
      WHERE {' AND '.join(f'{c} IS NOT NULL' for c in COLS)}"""
}


def _regime(p):
    days = p.obs.select("site_number", "date", (F.col("q_cfs") * 0.028316846592).alias("value"))
    return regions.regime(days)


def _features(p):
    coords = p.site.select("site_number", "lon", "lat")
    return regions.features(_regime(p), p.site.select("site_number", "elev"), coords).select("site_number", *COLS)


@query("cl_regime", "SELECT * FROM regimes", MONTH_NAMES, _REGIME)
def cl_regime(p):
    return _regime(p)


@query("cl_features", "SELECT * FROM station_features", COLS, _FEATURES)
def cl_features(p):
    return _features(p)


@query(
    "cl_scale",
    "SELECT site_number, " + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS {c}" for c in COLS) + " FROM station_features",
    COLS,
    _FEATURES,
)
def cl_scale(p):
    return regions.scale_features(_features(p), COLS)


def _kmeans_sql(k: int) -> dict[str, str]:
    """25 moves of k centres; the first are the first stations by the MD5 of their number."""
    return {
        f"steps_{k}": f"""SELECT id, c FROM (WITH RECURSIVE s(it, id, c) AS (
          SELECT 0, CAST(row_number() OVER (ORDER BY md5(site_number), site_number) AS INTEGER), v FROM scaled_vectors QUALIFY row_number() OVER (ORDER BY md5(site_number), site_number) <= {k}
          UNION ALL SELECT it + 1, id, [{', '.join(f'avg(v[{i}])' for i in range(1, len(COLS) + 1))}] FROM (
            SELECT f.site_number, f.v, s.it, arg_min(s.id, {{'d': list_distance(f.v, s.c), 'id': s.id}}) AS id
            FROM scaled_vectors f, s WHERE s.it < 25 GROUP BY f.site_number, f.v, s.it) GROUP BY it, id)
          SELECT * FROM s) WHERE it = 25""",
        f"labels_{k}": f"""SELECT site_number, v, arg_min(id, {{'d': list_distance(v, c), 'id': id}}) AS cluster
          FROM scaled_vectors, steps_{k} GROUP BY 1, 2""",
    }


_SCALED = _FEATURES | {
    "scaled_vectors": "SELECT site_number, ["
    + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()" for c in COLS)
    + "] AS v FROM station_features"
}
_SWEEP = (2, 3, 4, 5)


@query("cl_kmeans", "SELECT site_number, cluster FROM labels_5", (), _SCALED | _kmeans_sql(5))
def cl_kmeans(p):
    return regions.kmeans(regions.scale_features(_features(p), COLS), "site_number", COLS, k=5).select("site_number", "cluster")


@query("cl_kmeans_exchange")
def cl_kmeans_exchange(p):
    return transfer.kmeans(regions.scale_features(_features(p), COLS), "site_number", COLS, k=5).select("site_number", "cluster")


_CENTRES = {
    "centre_parts": "SELECT cluster, i, avg(x) AS c FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, 65)) AS i FROM vectors) GROUP BY 1, 2",
    "centre_rows": "SELECT cluster, list(c ORDER BY i) AS centre FROM centre_parts GROUP BY cluster",
    "nearest_rows": """SELECT vec_id, v, arg_min(c.cluster, list_distance(v, centre)) AS nearest, min(list_distance(v, centre)) AS distance
      FROM vectors, centre_rows c GROUP BY vec_id, v""",
}


@query("cl_assign", "SELECT vec_id, nearest, distance FROM nearest_rows", "distance", _CENTRES)
def cl_assign(p):
    centres = regions.mean_vectors(p.vectors, "cluster", "v")
    return regions.assign(p.vectors, "v", centres, "cluster").select("vec_id", "nearest", "distance")


@query(
    "cl_lloyd_step",
    """SELECT nearest AS cluster, CAST(i AS INTEGER) AS dim, avg(x) AS value, count(*) AS n
      FROM (SELECT nearest, unnest(v) AS x, unnest(range(0, 64)) AS i FROM nearest_rows) GROUP BY 1, 2""",
    "value",
    _CENTRES,
)
def cl_lloyd_step(p):
    centres = regions.mean_vectors(p.vectors, "cluster", "v")
    moved = regions.lloyd_step(p.vectors, "v", centres, "cluster")
    return moved.select("cluster", F.posexplode("centre").alias("dim", "value"), "n")


@query(
    "cl_split",
    """SELECT site_number, CASE WHEN cluster = 3 AND lat > 38 AND lon > -97.5::DOUBLE THEN 15
      WHEN cluster = 1 AND lon > -97.5::DOUBLE THEN 16 ELSE cluster END AS cluster FROM site""",
)
def cl_split(p):
    east = F.col("lon") > -97.5
    rules = [(3, (F.col("lat") > 38) & east, 15), (1, east, 16)]
    return regions.split_cluster(p.site, rules).select("site_number", "cluster")


_PAIRS = {
    "pair_sums": """SELECT a.vec_id, a.cluster AS own, b.cluster AS other, sum(list_distance(a.v, b.v)) AS total,
      count(*) FILTER (a.vec_id <> b.vec_id) AS n FROM vectors a, vectors b GROUP BY 1, 2, 3""",
    "ab": """SELECT vec_id, own AS cluster, max(total / nullif(n, 0)) FILTER (own = other) AS a, min(total / n) FILTER (own <> other) AS b
      FROM pair_sums GROUP BY 1, 2""",
}


@query(
    "cl_silhouette",
    "SELECT vec_id, CAST(cluster AS BIGINT) AS cluster, a, b, CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS silhouette FROM ab",
    "a b silhouette",
    _PAIRS,
)
def cl_silhouette(p):
    return regions.silhouette(p.vectors, "vec_id", "v", "cluster")


@query(
    "cl_silhouette_mean",
    "SELECT CAST(cluster AS BIGINT) AS cluster, count(*) AS n, avg((b - a) / greatest(a, b)) AS width FROM ab GROUP BY 1",
    "width",
    _PAIRS,
)
def cl_silhouette_mean(p):
    s = regions.silhouette(p.vectors, "vec_id", "v", "cluster")
    return s.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("silhouette").alias("width"))


@query(
    "cl_dunn",
    """SELECT separation, diameter, separation / diameter AS dunn FROM (
      SELECT min(list_distance(a.v, b.v)) FILTER (a.cluster <> b.cluster) AS separation,
        max(list_distance(a.v, b.v)) FILTER (a.cluster = b.cluster) AS diameter FROM vectors a, vectors b)""",
    "separation diameter dunn",
)
def cl_dunn(p):
    return regions.dunn(p.vectors, "vec_id", "v", "cluster")


@query(
    "cl_sweep",
    " UNION ALL ".join(
        f"""SELECT {k} AS clusters, min(list_distance(a.v, b.v)) FILTER (a.cluster <> b.cluster)
          / nullif(max(list_distance(a.v, b.v)) FILTER (a.cluster = b.cluster), 0) AS dunn FROM labels_{k} a, labels_{k} b"""
        for k in _SWEEP
    ),
    "dunn",
    _SCALED | {n: t for k in _SWEEP for n, t in _kmeans_sql(k).items()},
)
def cl_sweep(p):
    return regions.validity_sweep(regions.scale_features(_features(p), COLS), "site_number", COLS, _SWEEP)


@query(
    "cl_centroid",
    """SELECT site_number, cen_x, cen_y, d AS distance, CASE WHEN d < 25 THEN cen_x2 END AS cen_x2, CASE WHEN d < 25 THEN cen_y2 END AS cen_y2,
      CASE WHEN d < 25 THEN sqrt((lon - cen_x2) ** 2 + (lat - cen_y2) ** 2) END AS distance2 FROM (
      SELECT *, avg(lon) FILTER (d < 25) OVER (PARTITION BY cluster) AS cen_x2, avg(lat) FILTER (d < 25) OVER (PARTITION BY cluster) AS cen_y2 FROM (
      SELECT *, sqrt((lon - cen_x) ** 2 + (lat - cen_y) ** 2) AS d FROM (
      SELECT *, avg(lon) OVER (PARTITION BY cluster) AS cen_x, avg(lat) OVER (PARTITION BY cluster) AS cen_y FROM site)))""",
    "cen_x cen_y distance cen_x2 cen_y2 distance2",
)
def cl_centroid(p):
    out = regions.centroids(p.site.select("site_number", "cluster", "lon", "lat"), "cluster", "lon", "lat")
    return out.drop("cluster", "lon", "lat")
