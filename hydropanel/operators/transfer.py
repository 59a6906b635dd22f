"""The exchange phase of k-means: rows move singly while that lowers the sum of squares within the clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydropanel.operators.regions import _lloyd, _nearest, mean_vectors
from hydropanel.sources import checkpoint_table

# A round must lower the sum of squares by this share of it; less is rounding.
_LEAST = 1e-12


class _Clusters:
    """Sizes and centres of the clusters: all that the driver holds of the rows."""

    def __init__(self, n: np.ndarray, sums: np.ndarray, centres: np.ndarray) -> None:
        self.n, self.sums = n, sums
        # an empty cluster keeps the centre it had
        self.centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)

    def table(self) -> Column:
        rows = [
            F.struct(
                F.lit(i).alias("id"),
                F.array(*[F.lit(float(x)) for x in c]).alias("centre"),
                F.lit(float(m / (m + 1))).alias("into"),
                F.lit(float(m / (m - 1)) if m > 1 else 0.0).alias("out"),
            )
            for i, (c, m) in enumerate(zip(self.centres, self.n.tolist(), strict=True), 1)
        ]
        return F.array(*rows)

    def after(self, moves) -> _Clusters:
        """With ``moves`` (from, to, rows, sum of their vectors)."""
        n, sums = self.n.copy(), self.sums.copy()
        for a, b, rows, total in moves:
            n[a - 1] -= rows
            n[b - 1] += rows
            sums[a - 1] -= total
            sums[b - 1] += total
        return _Clusters(n, sums, self.centres)

    def explained(self) -> float:
        """The sum of squares is a constant less this."""
        return float(((self.sums**2).sum(axis=1)[self.n > 0] / self.n[self.n > 0]).sum())


def _squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)


def _judged(rows: DataFrame, clusters: _Clusters, drift: float, row_id: str) -> DataFrame:
    """Best move of every row, what it gains, and a lower bound of the distance to any other centre.

    A row leaves a for b if n_a/(n_a - 1) d(a)^2 > n_b/(n_b + 1) d(b)^2. Centres that moved by at most ``drift`` are no nearer than
    the bound less the drift, and most rows are settled by that and the distance to their own centre.
    """
    table = clusters.table()
    own = F.element_at(table, F.col("label"))
    stay = own["out"] * _squared(F.col("_v"), own["centre"])
    bound = F.greatest(F.col("lower") - F.lit(drift), F.lit(0.0))
    others = F.filter(table, lambda c: c["id"] != F.col("label"))
    moves = F.transform(others, lambda c: F.struct((c["into"] * _squared(F.col("_v"), c["centre"])).alias("cost"), c["id"].alias("to")))
    nearest = F.array_min(F.transform(others, lambda c: _squared(F.col("_v"), c["centre"])))
    best = F.array_min(moves)
    looked = F.struct(best["to"].alias("to"), (F.col("stay") - best["cost"]).alias("gain"), F.sqrt(nearest).alias("lower"), F.lit(True).alias("compared"))
    known = F.struct(F.lit(None).cast("int").alias("to"), F.lit(0.0).alias("gain"), bound.alias("lower"), F.lit(False).alias("compared"))
    least_into = float((clusters.n / (clusters.n + 1)).min())
    settled = F.col("stay") <= F.lit(least_into) * bound * bound
    return rows.withColumn("stay", stay).withColumn("_j", F.when(settled, known).otherwise(looked)).select(row_id, "_v", "label", "_j.*")


def _sums(judged: DataFrame, above: float) -> list[tuple]:
    """From, to, rows and vector sum of the moves that gain more than ``above``: at most one row per pair of clusters."""
    moved = mean_vectors(judged.where(F.col("gain") > above), ["label", "to"], "_v").collect()
    return [(r["label"], r["to"], r["n"], np.array(r["centre"]) * r["n"]) for r in sorted(moved)]


def _single(judged: DataFrame, row_id: str) -> dict[object, tuple]:
    """The best move of each pair of clusters, best first, those that share no cluster with a better one: their gains add."""
    best = judged.where("gain > 0").groupBy("label", "to").agg(F.max_by(F.struct("gain", row_id, "_v"), F.struct("gain", row_id)).alias("best"))
    chosen, used = {}, set()
    for r in sorted(best.collect(), key=lambda r: (-r["best"]["gain"], r["label"], r["to"])):
        if not used & {r["label"], r["to"]}:
            used |= {r["label"], r["to"]}
            chosen[r["best"][row_id]] = (r["label"], r["to"], 1, np.array(r["best"]["_v"]))
    return chosen


def exchange(rows: DataFrame, row_id: str, vec: str, centres: list[list[float]], rounds: int = 100, trace: list | None = None) -> DataFrame:
    """``row_id`` and ``label`` after the exchange phase, from the nearest of ``centres``.

    A round moves all rows that would gain by moving alone, if the sum of squares then falls; it is known exactly from the sizes and
    vector sums of the moves between each pair of clusters. Otherwise it tries those with half the largest gain, and at last the
    best move of each pair of clusters that shares none with a better one, which always lowers the sum. It ends when no row gains, or after
    ``rounds``. Every round is a written table. ``row_id`` must be unique. ``trace`` takes (rows compared with all centres, share of the sum) by round.
    """
    first = rows.select(row_id, F.col(vec).alias("_v"), _nearest(vec, F.array(*[F.struct(F.lit(i).alias("id"), F.array(*[F.lit(float(x)) for x in c]).alias("centre")) for i, c in enumerate(centres, 1)]))["id"].alias("label"))
    state = checkpoint_table(first.withColumn("lower", F.lit(0.0)))
    at = np.array(centres, float)
    n, sums = np.zeros(len(at), np.int64), np.zeros_like(at)
    for r in mean_vectors(state, "label", "_v").collect():
        n[r["label"] - 1], sums[r["label"] - 1] = r["n"], np.array(r["centre"]) * r["n"]
    clusters = _Clusters(n, sums, at)
    total = state.agg(F.sum(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x))).first()[0] or 0.0
    drift = 0.0
    for _ in range(rounds):
        judged = checkpoint_table(_judged(state, clusters, drift, row_id))
        least = _LEAST * total
        if trace is not None:
            trace.append((judged.where("compared").count(), total - clusters.explained()))
        top = judged.agg(F.max("gain")).first()[0]
        if top is None or top <= least:
            return judged.select(row_id, "label")
        goes = None
        for above in (least, top / 2):
            moved = clusters.after(_sums(judged, above))
            if moved.explained() > clusters.explained() + least:
                goes = F.col("gain") > above
                break
        if goes is None:
            single = _single(judged, row_id)
            moved, goes = clusters.after(single.values()), F.col(row_id).isin(list(single)) & (F.col("gain") > 0)
        drift = float(np.sqrt(((moved.centres - clusters.centres) ** 2).sum(axis=1)).max())
        # a row that moved has no bound for its old centre yet
        state = judged.select(row_id, "_v", F.when(goes, F.col("to")).otherwise(F.col("label")).alias("label"), F.when(goes, 0.0).otherwise(F.col("lower")).alias("lower"))
        clusters = moved
    return state.select(row_id, "label")


def kmeans(df: DataFrame, row_id: str, cols, k: int = 5, max_iter: int = 25, rounds: int = 100, name: str = "cluster") -> DataFrame:
    """k-means regions as ``regions.kmeans`` gives them, followed by the exchange phase: the sum of squares is never above that one's,
    and the labels are the same where no row gains by moving. Rows need all their features and a unique id."""
    rows = checkpoint_table(df.withColumn("_v", F.array(*cols)))
    centres = _lloyd(rows, row_id, "_v", [k], max_iter)[k]
    if not centres:
        return rows.withColumn(name, F.lit(None).cast("int")).drop("_v")
    return rows.drop("_v").join(exchange(rows, row_id, "_v", centres, rounds).withColumnRenamed("label", name), row_id)
