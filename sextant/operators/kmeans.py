"""k-means (C1-C3): a sweep over k from one weighted summary, and single Lloyd steps.

The sweep draws one summary of the rows for all k: a few rounds, each one
scan, add rows with a probability in proportion to their squared distance
from those drawn before, and one more scan weights them by the rows nearest to
them.  Seeding and Lloyd on the summary, a few thousand weighted points
whatever the table's size, give starting centres for every k; then every
Lloyd step is one scan that serves all k: a task keeps the sums of the
centres it meets and emits one row for each.  The number of scans does not
depend on the number of values of k.  Centres are sum(k) x d numbers and
travel to the tasks, in as many passes as their bound on bytes asks for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.operators.quality import centroids
from sextant.session import cut_lineage

MAX_CENTERS = 100_000
SEED = 42
#: Rounds of the summary, rows drawn by each for every centre of the largest k, bytes of centres that go to a task.
SUMMARY_ROUNDS, DRAWN_PER_CENTER, CENTER_BYTES = 5, 2, 64 << 20


def clamp_k_range(n_rows: int, lo: int = 2, hi: int = 200) -> range:
    """``range(lo, min(hi, n_rows))``; always applied (fixes B7, B8)."""
    return range(lo, min(hi, n_rows))


def collect_centers(centers: DataFrame) -> np.ndarray:
    """``(cluster_id, center)`` -> K x d matrix ordered by cluster id, after a size check."""
    n = centers.limit(MAX_CENTERS + 1).count()
    if n > MAX_CENTERS:
        raise ValueError(f"{n} centres exceed the broadcast bound {MAX_CENTERS}")
    rows = centers.orderBy("cluster_id").select("cluster_id", "center").collect()
    return np.array([r["center"] for r in rows], dtype=np.float64), [r["cluster_id"] for r in rows]


def assign(vectors: DataFrame, centers: np.ndarray, id_col: str = "id",
           vec_col: str = "embedding", center_ids: list[int] | None = None) -> DataFrame:
    """Nearest centre by squared Euclidean distance; ties -> the lower centre index."""
    spark = vectors.sparkSession
    bc = spark.sparkContext.broadcast(np.asarray(centers, dtype=np.float64))
    ids = np.asarray(center_ids if center_ids is not None else range(len(centers)), dtype=np.int64)
    bc_ids = spark.sparkContext.broadcast(ids)

    @F.pandas_udf("int")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = bc.value
        cid = bc_ids.value
        for vecs in batches:
            if len(vecs) == 0:
                yield pd.Series([], dtype="int32")
                continue
            x = np.vstack([np.asarray(v, dtype=np.float64) for v in vecs])
            best = np.zeros(len(x), dtype=np.int64)
            best_d = np.full(len(x), np.inf)
            for j in range(len(c)):  # per centre: exact differences, first minimum wins
                d = ((x - c[j]) ** 2).sum(1)
                better = d < best_d
                best[better], best_d[better] = j, d[better]
            yield pd.Series(cid[best].astype(np.int32))

    return vectors.select(id_col, nearest(F.col(vec_col)).alias("cluster_id"))


def lloyd(vectors: DataFrame, init_centers: np.ndarray, steps: int, id_col: str = "id",
          vec_col: str = "embedding"):
    """``steps`` Lloyd iterations from ``init_centers``; an empty cluster keeps its centre.

    Returns ``(assignment DataFrame (id, cluster_id), centres K x d)``; the
    assignment is the one computed against the final centres.
    """
    c = np.asarray(init_centers, dtype=np.float64)
    for _ in range(steps):
        labels = assign(vectors, c, id_col, vec_col)
        new, ids = collect_centers(centroids(vectors, labels, None, id_col, vec_col))
        nxt = c.copy()
        for cid, row in zip(ids, new):
            nxt[cid] = row
        c = nxt
    return assign(vectors, c, id_col, vec_col), c


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    lists = batch.column(column)
    return pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1)[None, :], 0.0)


def summary(rows: DataFrame, most: int, rounds: int = SUMMARY_ROUNDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Points and weights that stand for the rows ``(id, x)`` in fits of up to ``most`` centres.

    A round draws ``2 * most`` rows without replacement: a task keeps those of
    the greatest log(u) / d^2, with u from a hash of the id, and the driver
    the greatest of all, so it sees a bounded number of rows.
    """
    drawn, points = DRAWN_PER_CENTER * most, None
    for r in range(rounds):
        u = ((F.pmod(F.xxhash64(F.lit(seed), F.lit(r), "id"), F.lit(1 << 30)) + 0.5) / float(1 << 30)).alias("u")
        known = points

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _parts(batches):
                x = _matrix(part, "x")
                d = np.ones(len(x)) if known is None else _squared(x, known).min(axis=1)
                with np.errstate(divide="ignore"):
                    key = np.where(d > 0, np.log(part.column("u").to_numpy()) / d, -np.inf)
                best = np.argsort(-key, kind="stable")[:drawn]
                best = best[np.isfinite(key[best])]
                yield pa.RecordBatch.from_arrays([pa.array(key[best]), pa.array(list(x[best]), pa.list_(pa.float64()))], ["key", "x"])
        more = rows.select("x", u).mapInArrow(run, "key double, x array<double>").orderBy(F.desc("key"), "x").limit(drawn if r else 1).collect()
        if not more:
            break
        fresh = np.unique(np.array([m["x"] for m in more]), axis=0)
        points = fresh if points is None else np.concatenate([points, fresh])
    if points is None:
        return np.zeros((0, 0)), np.zeros(0)
    (_, n, _), = lloyd_scan(rows, [points])
    return points, n.astype(np.float64)


def lloyd_scan(rows: DataFrame, sets: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """One scan for all sets of centres: for each the means of their members (a centre without any stays), their sizes and the cost."""
    ends = np.cumsum([len(c) for c in sets])
    every, starts = np.concatenate(sets), ends - [len(c) for c in sets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n, cost = np.zeros_like(every), np.zeros(len(every), dtype=np.int64), np.zeros(len(every))
        for part in _parts(batches, max(64, (1 << 22) // len(every))):
            x = _matrix(part, "x")
            d = _squared(x, every)
            for a, b in zip(starts, ends):
                near = a + d[:, a:b].argmin(axis=1)
                np.add.at(sums, near, x)
                np.add.at(cost, near, d[np.arange(len(x)), near])
                n += np.bincount(near, minlength=len(every))
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(n[met]), pa.array(cost[met]), pa.array(list(sums[met]), pa.list_(pa.float64()))],
                                         ["at", "n", "cost", "sums"])

    def add(key: tuple, group: pa.Table) -> pa.Table:
        total = pc.list_flatten(group.column("sums").combine_chunks()).to_numpy(zero_copy_only=False).reshape(group.num_rows, -1).sum(axis=0)
        return pa.table({"at": [key[0].as_py()], "n": [pc.sum(group.column("n")).as_py()], "cost": [pc.sum(group.column("cost")).as_py()],
                         "sums": pa.array([total], pa.list_(pa.float64()))})

    schema = "at long, n long, cost double, sums array<double>"
    centers, sizes, cost = every.copy(), np.zeros(len(every), dtype=np.int64), np.zeros(len(every))
    for r in rows.select("x").mapInArrow(run, schema).groupBy("at").applyInArrow(add, schema).collect():  # one row per centre
        centers[r["at"]], sizes[r["at"]], cost[r["at"]] = np.array(r["sums"]) / r["n"], r["n"], r["cost"]
    return [(centers[a:b], sizes[a:b], float(cost[a:b].sum())) for a, b in zip(starts, ends)]


def seed_centers(points: np.ndarray, weights: np.ndarray, k: int, seed: int = SEED, steps: int = 20) -> np.ndarray:
    """At most k centres of weighted points: weighted k-means++ seeds, then Lloyd on the points."""
    rng = np.random.default_rng([seed, k])
    centers = points[[int(rng.choice(len(points), p=weights / weights.sum()))]]
    near = _squared(points, centers).min(axis=1)
    while len(centers) < k and (near * weights).sum() > 0:
        at = int(rng.choice(len(points), p=near * weights / (near * weights).sum()))
        centers = np.concatenate([centers, points[[at]]])
        near = np.minimum(near, _squared(points, points[[at]])[:, 0])
    for _ in range(steps):
        label = _squared(points, centers).argmin(axis=1)
        mass = np.bincount(label, weights, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, label, points * weights[:, None])
        moved = np.where(mass[:, None] > 0, sums / np.where(mass, mass, 1.0)[:, None], centers)
        if np.array_equal(moved, centers):
            break
        centers = moved
    return centers


def fit_centers(rows: DataFrame, ks: list[int], steps: int, seed: int = SEED, tolerance: float = 0.0) -> tuple[list[np.ndarray], list[float], list[float]]:
    """Centres of ``(id, x)`` rows for every k, with the costs of the seeds and of the centres before the last step."""
    points, weights = summary(rows, max(ks), seed=seed)
    if not len(points):
        return [np.zeros((0, 0)) for _ in ks], [0.0] * len(ks), [0.0] * len(ks)
    points, weights = points[weights > 0], weights[weights > 0]
    sets, first, last = [seed_centers(points, weights, k, seed) for k in ks], None, None
    for _ in range(steps):
        new, costs, at = [], [], 0
        while at < len(sets):  # as many sets as may travel together
            to = at + 1
            while to < len(sets) and sum(c.nbytes for c in sets[at:to + 1]) <= CENTER_BYTES:
                to += 1
            for centers, _, cost in lloyd_scan(rows, sets[at:to]):
                new.append(centers)
                costs.append(cost)
            at = to
        first, last = first or costs, costs
        moved = max(float(np.abs(a - b).max()) for a, b in zip(new, sets))
        sets = new
        if moved <= tolerance:
            break
    return sets, first or [0.0] * len(ks), last or [0.0] * len(ks)


def fit_rows(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return cut_lineage(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("x")))


def nearest_labels(rows: DataFrame, sets: list[np.ndarray], indices: list[int]) -> DataFrame:
    """``(param_idx, id, cluster_id)``: the nearest centre of every set, in one scan."""
    every = np.concatenate(sets)
    ends = np.cumsum([len(c) for c in sets])
    starts = ends - [len(c) for c in sets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, max(64, (1 << 22) // max(len(every), 1))):
            d = _squared(_matrix(part, "x"), every)
            for p, a, b in zip(indices, starts, ends):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), p, dtype=np.int32)), part.column("id"),
                                                  pa.array(d[:, a:b].argmin(axis=1).astype(np.int32))], ["param_idx", "id", "cluster_id"])
    return rows.mapInArrow(run, f"param_idx int, id {rows.schema['id'].dataType.simpleString()}, cluster_id int")


def fit_kmeans_model(vectors: DataFrame, k: int, id_col: str = "id", vec_col: str = "embedding",
                     seed: int = SEED, steps: int = 100) -> tuple[DataFrame, np.ndarray]:
    """``(id, cluster_id)`` and the K x d centres of a fit that goes on until no centre moves, or for ``steps`` scans."""
    rows = fit_rows(vectors, id_col, vec_col)
    (centers,), _, _ = fit_centers(rows, [k], steps, seed, tolerance=1e-12)
    return nearest_labels(rows, [centers], [k]).select(F.col("id").alias(id_col), "cluster_id"), centers


def fit_kmeans(vectors: DataFrame, k: int, id_col: str = "id", vec_col: str = "embedding",
               seed: int = SEED) -> DataFrame:
    """The labels of :func:`fit_kmeans_model`."""
    return fit_kmeans_model(vectors, k, id_col, vec_col, seed)[0]


def kmeans_sweep(vectors: DataFrame, ks, id_col: str = "id", vec_col: str = "embedding",
                 parallelism: int | None = None, steps: int = 5) -> DataFrame:
    """One fit per k -> ``(param_idx = k, id, cluster_id)``; all k share every scan.

    ``parallelism`` is taken for callers that ran fits side by side and has no effect.
    """
    rows, ks = fit_rows(vectors, id_col, vec_col), [int(k) for k in ks]
    sets, _, _ = fit_centers(rows, ks, steps)
    return nearest_labels(rows, sets, ks).select("param_idx", F.col("id").alias(id_col), "cluster_id")
