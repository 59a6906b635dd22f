"""Flow regimes, k-means regions and their validity."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydropanel.functions import calendar, units
from hydropanel.operators.extremes import extremes
from hydropanel.operators.pairs import BLOCK_ROWS, PIECE, blocked_pairs, distances, pieces, squares
from hydropanel.operators.reshape import MONTH_NAMES
from hydropanel.operators.rows import complete, update_where
from hydropanel.operators.windows import add_group_agg, share_of_peak
from hydropanel.sources import checkpoint_table


def regime(daily: DataFrame, site: str = "site_number", date: str = "date", value: str = "value") -> DataFrame:
    """Mean over the years of month peak over year peak, one column per month."""
    days = daily.filter(F.col(value) > 0).select(
        site, calendar.water_year(date).alias("year"), F.month(date).alias("month"), value
    )
    share = share_of_peak(days, site, "year", "month", value)
    return share.groupBy(site).agg(
        *[F.avg(F.when(F.col("month") == m, F.col("share"))).alias(n) for m, n in enumerate(MONTH_NAMES, 1)]
    )


def features(regimes: DataFrame, elevation: DataFrame, coordinates: DataFrame, site: str = "site_number") -> DataFrame:
    """Regime with elevation and coordinates, complete rows only."""
    return complete(regimes.join(elevation, site).join(coordinates, site))


def scale_features(df: DataFrame, cols) -> DataFrame:
    """Standardise columns over all rows (mean 0, sample deviation 1).

    The statistics are one row, taken as a scalar subquery.
    """
    stats = df.select(
        F.struct(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[
            F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(cols)
        ]).alias("s")
    ).scalar()
    out = df.withColumn("_s", stats)
    return out.withColumns(
        {c: F.try_divide(F.col(c) - F.col(f"_s.m{i}"), F.col(f"_s.s{i}")) for i, c in enumerate(cols)}
    ).drop("_s")


def _centre_table(centres) -> Column:
    """Centres numbered from 1 as one array value."""
    return F.array(*[F.struct(F.lit(i).alias("id"), F.array(*[F.lit(float(x)) for x in c]).alias("centre")) for i, c in enumerate(centres, 1)])


def _nearest(vec: str, table: Column) -> Column:
    """Squared distance and number of the nearest centre (ties to the lower number)."""

    def squared(c: Column) -> Column:
        diffs = F.zip_with(F.col(vec), c["centre"], lambda a, b: (a - b) * (a - b))
        return F.aggregate(diffs, F.lit(0.0), lambda s, d: s + d)

    return F.array_min(F.transform(table, lambda c: F.struct(squared(c).alias("d2"), c["id"].alias("id"))))


def _lloyd(rows: DataFrame, row_id: str, vec: str, ks: list[int], max_iter: int) -> dict[int, list[list[float]]]:
    """Centres per number of clusters, after at most ``max_iter`` moves of all of them together.

    The first centres are the first rows by the MD5 of the id. A centre that loses all its rows stays. Only the
    centres come to the driver, which are as many as the clusters.
    """
    firsts = rows.orderBy(F.md5(F.col(row_id).cast("string")), row_id).select(vec).limit(max(ks)).collect()
    centres = {k: [list(r[0]) for r in firsts[:k]] for k in ks}
    for _ in range(max_iter if firsts else 0):
        labels = F.array(*[F.struct(F.lit(k).alias("k"), _nearest(vec, _centre_table(c))["id"].alias("id")) for k, c in centres.items()])
        moved = {k: list(c) for k, c in centres.items()}
        for r in mean_vectors(rows.select(vec, F.inline(labels)), ["k", "id"], vec).collect():
            moved[r["k"]][r["id"] - 1] = r["centre"]
        if moved == centres:
            break
        centres = moved
    return centres


def kmeans(df: DataFrame, row_id: str, cols, k: int = 5, max_iter: int = 25, name: str = "cluster") -> DataFrame:
    """k-means regions numbered from 1, the same on every cluster: see ``_lloyd`` for the rule.

    The iterations read the rows many times, so these are written to the shared folder first. Rows need
    all their features (``features`` keeps such rows only).
    """
    rows = checkpoint_table(df.withColumn("_v", F.array(*cols)))
    centres = _lloyd(rows, row_id, "_v", [k], max_iter)[k]
    label = _nearest("_v", _centre_table(centres))["id"] if centres else F.lit(None).cast("int")
    return rows.withColumn(name, label).drop("_v")


def mean_vectors(df: DataFrame, cluster, vec: str) -> DataFrame:
    """Mean vector of every cluster, one partial row per map task and cluster."""
    keys = [cluster] if isinstance(cluster, str) else list(cluster)
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col(vec))))
    return df.groupBy(*keys).agg(mean.alias("centre"), F.count(F.lit(1)).alias("n"))


def assign(df: DataFrame, vec: str, centres: DataFrame, cluster: str, name: str = "nearest") -> DataFrame:
    """Nearest centre of every row (ties to the lower number).

    The k centres arrive as one array value and the minimum is taken inside the row:
    no join and no shuffle.
    """
    table = centres.select(
        F.sort_array(F.collect_list(F.struct(F.col(cluster).alias("id"), F.col("centre")))).alias("c")
    ).scalar()
    best = df.withColumn("_c", table).withColumn("_best", _nearest(vec, F.col("_c")))
    return best.withColumns({name: F.col("_best.id"), "distance": F.sqrt(F.col("_best.d2"))}).drop("_c", "_best")


def lloyd_step(df: DataFrame, vec: str, centres: DataFrame, cluster: str) -> DataFrame:
    """Assign every row, then the new mean of every cluster."""
    moved = assign(df, vec, centres, cluster, "_nearest")
    return mean_vectors(moved, "_nearest", vec).withColumnRenamed("_nearest", cluster)


def split_cluster(df: DataFrame, rules, cluster: str = "cluster") -> DataFrame:
    """Give rows of a cluster that meet a condition a new number; rules are ``(old, condition, new)``."""
    for old, condition, new in rules:
        df = update_where(df, (F.col(cluster) == old) & condition, {cluster: F.lit(new)})
    return df


def _matrix(pdf: pd.DataFrame, vec: str) -> np.ndarray:
    return np.stack(pdf[vec].to_numpy()).astype(float)


def silhouette(df: DataFrame, row_id: str, vec: str, cluster: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact silhouette of every row with plain Euclidean distances.

    Distances are summed per row and cluster inside the block tasks, which return one row
    per row, cluster and partner block.  The work is quadratic by definition; memory is bounded by the block.
    """
    base = df.select(F.col(row_id).alias("id"), F.col(cluster).cast("long").alias("own"), F.col(vec).alias("v"))

    def sums(same: bool, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        va, vb = _matrix(a, "v"), _matrix(b, "v")
        (la, ia), (lb, ib) = (np.unique(x["own"].to_numpy(), return_inverse=True) for x in (a, b))
        of_a, of_b = np.eye(len(la))[ia], np.eye(len(lb))[ib]
        to_b, to_a = np.zeros((len(a), len(lb))), np.zeros((len(b), len(la)))
        for i in pieces(len(a)):
            for j in pieces(len(b)):
                d = distances(va[i], vb[j])
                if same and i == j:
                    np.fill_diagonal(d, 0.0)
                to_b[i] += d @ of_b[j]
                if not same:
                    to_a[j] += d.T @ of_a[i]

        def rows(left: pd.DataFrame, labels: np.ndarray, totals: np.ndarray) -> pd.DataFrame:
            ids, own = (np.repeat(left[c].to_numpy(), len(labels)) for c in ("id", "own"))
            return pd.DataFrame({"id": ids, "own": own, "other": np.tile(labels, len(left)), "total": totals.ravel()})

        parts = [rows(a, lb, to_b)] if same else [rows(a, lb, to_b), rows(b, la, to_a)]
        return pd.concat(parts)

    id_type = dict(df.dtypes)[row_id]
    partial = blocked_pairs(base, F.col("id"), sums, f"id {id_type}, own long, other long, total double", None, block_rows)
    counts = base.groupBy(F.col("own").alias("other")).agg(F.count(F.lit(1)).alias("n"))
    per = partial.groupBy("id", "own", "other").agg(F.sum("total").alias("total")).join(counts, "other")
    mine = F.col("other") == F.col("own")
    s = per.groupBy("id", "own").agg(
        F.max(F.when(mine, F.try_divide(F.col("total"), F.col("n") - 1))).alias("a"),
        F.min(F.when(~mine, F.col("total") / F.col("n"))).alias("b"),
        F.max(F.when(mine, F.col("n"))).alias("n_own"),
    )
    width = F.when(F.col("n_own") == 1, F.lit(0.0)).otherwise(
        F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))
    )
    return s.select(F.col("id").alias(row_id), F.col("own").alias(cluster), "a", "b", width.alias("silhouette"))


def _extremes(df: DataFrame, row_id: str, vec: str, clusters: dict[int, str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per clustering the smallest distance between clusters and the largest within one, from one pass over the pairs.

    Rows of a block are sorted by their clusters, so the extremes of a piece are taken once for each pair of runs, however many clusterings
    there are. Rows without a cluster do not count in that clustering.
    """
    ks, columns = list(clusters), list(clusters.values())
    own = [F.col(c).cast("long").alias(f"own{i}") for i, c in enumerate(columns)]
    names = [f"own{i}" for i in range(len(ks))]
    base = df.select(F.col(row_id).alias("id"), F.col(vec).alias("v"), *own).where(F.col("v").isNotNull() & F.coalesce(*names).isNotNull())

    def of_blocks(same: bool, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        def arranged(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
            """Rows sorted by clusters, their clusters, and where the runs of each piece begin."""
            labels = frame[names].astype(float).to_numpy()
            order = np.lexsort(labels.T)
            labels = labels[order]
            new = np.r_[True, ((labels[1:] != labels[:-1]) & ~(np.isnan(labels[1:]) & np.isnan(labels[:-1]))).any(axis=1)]
            new[::PIECE] = True
            return _matrix(frame, "v")[order], labels, [np.flatnonzero(new[i]) for i in pieces(len(order))]

        va, la, ra = arranged(a)
        vb, lb, rb = (va, la, ra) if same else arranged(b)
        between, within = np.full(len(ks), np.inf), np.full(len(ks), -np.inf)
        for i, of_a in zip(pieces(len(va)), ra, strict=True):
            for j, of_b in zip(pieces(len(vb)), rb, strict=True):
                if same and i.start > j.start:
                    continue
                d = squares(va[i], vb[j])
                if same and i == j:
                    np.fill_diagonal(d, 0.0)
                low = np.minimum.reduceat(np.minimum.reduceat(d, of_b, axis=1), of_a, axis=0)
                high = np.maximum.reduceat(np.maximum.reduceat(d, of_b, axis=1), of_a, axis=0)
                for n in range(len(ks)):
                    left, right = la[i][of_a, n, None], lb[j][of_b, n]
                    between[n] = min(between[n], low[(left < right) | (left > right)].min(initial=np.inf))
                    within[n] = max(within[n], high[left == right].max(initial=-np.inf))
        found = {"between": [np.sqrt(x) if np.isfinite(x) else None for x in between], "within": [np.sqrt(x) if np.isfinite(x) else None for x in within]}
        return pd.DataFrame({"clusters": ks} | found)

    parts = blocked_pairs(base, F.col("id"), of_blocks, "clusters int, between double, within double", None, block_rows)
    parts = parts.groupBy("clusters").agg(F.min("between").alias("separation"), F.max("within").alias("diameter"))
    return parts.withColumn("dunn", F.try_divide("separation", "diameter"))


def _index(found: DataFrame) -> DataFrame:
    return found.select(
        F.col("between").alias("separation"), F.col("within").alias("diameter"), F.try_divide("between", "within").alias("dunn")
    )


def dunn(df: DataFrame, row_id: str, vec: str, cluster: str, block_rows: int = BLOCK_ROWS, compared: bool = False) -> DataFrame:
    """Smallest distance between clusters over the largest within one. Blocks of rows whose bounds cannot win are not compared (see
    ``extremes``); ``compared`` adds the share of pairs of rows that were. With very many clusters, or where bounds spare little, all blocks are compared."""
    pruned = extremes(df, row_id, vec, cluster)
    if pruned is None:
        out, share = _extremes(df, row_id, vec, {0: cluster}, block_rows).drop("clusters"), 1.0
    else:
        out, share = _index(pruned[0]), pruned[1]
    return out.withColumn("compared", F.lit(float(share))) if compared else out


def validity_sweep(df: DataFrame, row_id: str, cols, ks, max_iter: int = 25) -> DataFrame:
    """Dunn index for several numbers of clusters: the rows are written once, every iteration moves the
    centres of all ``ks``."""
    rows = checkpoint_table(df.select(row_id, F.array(*cols).alias("_vec")))
    centres = _lloyd(rows, row_id, "_vec", list(ks), max_iter)
    labels = {f"_k{k}": _nearest("_vec", _centre_table(c))["id"] for k, c in centres.items()}
    rows = checkpoint_table(rows.withColumns(labels))
    pruned = {k: extremes(rows, row_id, "_vec", f"_k{k}") for k in ks}
    found = [_index(p[0]).select(F.lit(k).alias("clusters"), "dunn") for k, p in pruned.items() if p is not None]
    rest = {k: f"_k{k}" for k, p in pruned.items() if p is None}
    if rest:
        found.append(_extremes(rows, row_id, "_vec", rest).select("clusters", "dunn"))
    return reduce(DataFrame.unionByName, found)


def centroids(df: DataFrame, cluster: str, x: str, y: str, max_dist: float = 25.0) -> DataFrame:
    """Region centroid, and the centroid of the members nearer than ``max_dist`` (NULL on the others)."""
    out = add_group_agg(df, [cluster], {"cen_x": F.avg(x), "cen_y": F.avg(y)}).withColumn(
        "distance", units.distance(x, y, "cen_x", "cen_y")
    )
    near = F.col("distance") < max_dist
    out = add_group_agg(
        out, [cluster], {"cen_x2": F.avg(F.when(near, F.col(x))), "cen_y2": F.avg(F.when(near, F.col(y)))}
    )
    out = out.withColumns({c: F.when(near, F.col(c)) for c in ("cen_x2", "cen_y2")})
    return out.withColumn("distance2", units.distance(x, y, "cen_x2", "cen_y2"))
