"""Cluster quality (A8-A10, E1-E7, J6, J7, W4, P6) for many labelings at once.

Labelings are a long table ``(param_idx, id, cluster_id)``.  They are packed
beside the vectors, keyed by attempt, so that all attempts share one pass
over the pairs; an attempt that misses a row, or has one without a vector,
fails with ``MISALIGNED_ATTEMPT`` while the rows are packed.

Silhouette: a task holds a block of rows, streams all rows past it and keeps
the distance sums per cluster in place, so one number per row and attempt
leaves it.  Davies-Bouldin is linear in the rows: tasks keep vector sums per
cluster and emit these, and a blocked pass compares the centroids.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.operators.blocks import DEFAULT_BLOCK_ROWS, euclidean_matrix, pairwise_apply, stack
from sextant.session import bounded_broadcast, cut_lineage

ATTEMPT = "param_idx"
ALLCLOSE_ATOL = 1e-8
#: Sums that a task keeps: rows times clusters of silhouettes, clusters of centroids.
SUMS_PER_TASK, CLUSTERS_PER_TASK = 32 << 20, 65_536
#: Rows of a silhouette task's own, distances that it holds at a time.
OWN_ROWS, TILE_PAIRS = 16_384, 1 << 19
HIGHER_IS_BETTER = {"silhouette": True, "balanced": True, "davies_bouldin": False}


def cluster_sizes(labels: DataFrame, key_cols: list[str] | None = None,
                  cluster_col: str = "cluster_id") -> DataFrame:
    """``(key.., cluster_id, size)``."""
    return labels.groupBy(*(key_cols or []), cluster_col).agg(F.count(F.lit(1)).alias("size"))


def attempt_summary(labels: DataFrame, key_cols: list[str] | None = None,
                    cluster_col: str = "cluster_id") -> DataFrame:
    """``(key.., n_rows, n_clusters, degenerate)``; noise counts as a cluster.

    An attempt is degenerate when ``K < 2`` or ``K > N - 1``.
    """
    k = list(key_cols or [])
    sizes = cluster_sizes(labels, k, cluster_col)
    agg = sizes.groupBy(*k).agg(F.sum("size").alias("n_rows"), F.count(F.lit(1)).alias("n_clusters"))
    return agg.withColumn("degenerate", (F.col("n_clusters") < 2) | (F.col("n_clusters") > F.col("n_rows") - 1))


def size_penalty(labels: DataFrame, lam: float = 0.5, key_cols: list[str] | None = None,
                 cluster_col: str = "cluster_id") -> DataFrame:
    """A10: ``sum_k |n_k/N - 1/K| * lam * stdev_sample(sizes) / mean(sizes)`` per key."""
    k = list(key_cols or [])
    if not k:
        labels, k = labels.withColumn("_g", F.lit(0)), ["_g"]
    sizes = cluster_sizes(labels, k, cluster_col)
    tot = sizes.groupBy(*k).agg(F.sum("size").alias("_N"), F.count(F.lit(1)).alias("_K"))
    s = sizes.join(tot, k)  # one row per key
    out = s.groupBy(*k).agg(
        (F.sum(F.abs(F.col("size") / F.col("_N") - F.lit(1.0) / F.col("_K"))) * F.lit(lam)
         * F.stddev_samp("size") / F.avg("size")).alias("penalty"))
    return out.drop("_g")


class Packed:
    """Rows ``(id, embedding, codes, clusters)``: a row's cluster of every attempt, in the order of ``attempts``.

    ``codes`` number an attempt's clusters from 0, ``clusters`` are their ids;
    ``counts`` has the number of clusters per attempt.  Attempts are a sweep's parameters.
    """

    def __init__(self, vectors: DataFrame, labels: DataFrame, id_col: str = "id", vec_col: str = "embedding"):
        self.sizes = cut_lineage(cluster_sizes(labels, [ATTEMPT]).withColumn(
            "code", F.row_number().over(Window.partitionBy(ATTEMPT).orderBy("cluster_id")) - 1))
        per = self.sizes.groupBy(ATTEMPT).agg(F.count("*").alias("k")).orderBy(ATTEMPT).collect()  # one row per attempt
        self.attempts, self.counts = [r[ATTEMPT] for r in per], [r["k"] for r in per]
        coded = labels.join(bounded_broadcast(self.sizes.select(ATTEMPT, "cluster_id", "code")), [ATTEMPT, "cluster_id"])
        entry = F.struct(ATTEMPT, F.struct("code", F.col("cluster_id").cast("int").alias("cluster_id")).alias("l"))
        by_attempt = coded.groupBy(F.col(id_col).alias("id")).agg(F.map_from_entries(F.collect_list(entry)).alias("by"))
        rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("embedding"), F.lit(True).alias("there"))
        rows = rows.join(by_attempt, "id", "full")
        lacking = F.filter(F.array(*[F.lit(a) for a in self.attempts]), lambda a: F.col("by").isNull() | ~F.map_contains_key("by", a))
        wrong = (F.when(F.col("there").isNull(), F.concat(F.lit("MISALIGNED_ATTEMPT: no vector for the labelled row "), F.col("id").cast("string")))
                 .when(F.size(lacking) > 0, F.concat(F.lit("MISALIGNED_ATTEMPT: row "), F.col("id").cast("string"),
                                                     F.lit(" has no label in attempt "), F.try_element_at(lacking, F.lit(1)).cast("string"))))
        placed = F.transform(F.array(*[F.lit(a) for a in self.attempts]), lambda a: F.col("by")[a])
        placed = F.when(wrong.isNotNull(), F.raise_error(wrong)).otherwise(placed)
        self.rows = cut_lineage(rows.withColumn("l", placed).select("id", "embedding", F.col("l.code").alias("codes"), F.col("l.cluster_id").alias("clusters")))
        moved = [F.max(F.col("codes")[k] != F.col("codes")[k - 1]).alias(f"m{k}") for k in range(1, len(self.attempts))]
        seen = self.rows.agg(F.count("*").alias("n"), *moved).first()  # one flag per attempt
        #: Whether an attempt has the same clusters as the one before it.
        self.n_rows, self.repeats = seen["n"], [False, *[not seen[f"m{k}"] for k in range(1, len(self.attempts))]]


def _flat(batch: pa.RecordBatch, column: str) -> np.ndarray:
    lists = batch.column(column)
    return pc.list_flatten(lists).to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _fold(counts: list[int], attempts: list, reps: list[int]) -> object:
    """The function of one row block: its rows come first (``_own``), then all rows, whose distances it sums per cluster.

    ``counts`` has the clusters of each labeling in ``codes``; attempt k has the ``reps[k]``-th of them.  Rows that
    are in the same clusters throughout come together, so a run of them is summed first and added to its clusters once.
    """
    starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    total = int(starts[-1])

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums, sizes, step = [], None, np.zeros(total, dtype=np.int64), 1
        for batch in batches:
            kind = batch.column("_own").to_numpy(zero_copy_only=False)
            if kind.any():
                own.append(batch.filter(pa.array(kind)))
                batch = batch.filter(pa.array(~kind))
            if batch.num_rows and sums is None:
                ids = np.concatenate([o.column("id").to_numpy() for o in own])
                x = np.concatenate([_flat(o, "embedding") for o in own])
                order, squares, xt = np.argsort(ids), (x * x).sum(axis=1), np.ascontiguousarray(-2.0 * x.T)
                sums = np.zeros((total, len(ids)))
                step = max(64, TILE_PAIRS // len(ids))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                other, code, y = part.column("id").to_numpy(), _flat(part, "codes") + starts[:-1], _flat(part, "embedding")
                d = y @ xt
                d += squares
                d += (y * y).sum(axis=1)[:, None]
                np.maximum(d, 0.0, out=d)
                np.sqrt(d, out=d)
                place = order[np.minimum(np.searchsorted(ids, other, sorter=order), len(ids) - 1)]
                same = np.flatnonzero(ids[place] == other)
                d[same, place[same]] = 0.0  # a row's distance to itself is exactly 0
                firsts = np.flatnonzero(np.append(True, (code[1:] != code[:-1]).any(axis=1)))
                added = np.add.reduceat(d, firsts, axis=0) if len(firsts) < len(d) else d
                for r, n in enumerate(np.diff(np.append(firsts, len(d)))):
                    sums[code[firsts[r]]] += added[r]
                    sizes[code[firsts[r]]] += n
        code = np.concatenate([_flat(o, "codes") for o in own])
        clusters = np.concatenate([_flat(o, "clusters") for o in own])
        rows, silhouettes = np.arange(len(ids)), []
        for k in range(len(counts)):
            s, n, c = sums[starts[k]:starts[k + 1]], sizes[starts[k]:starts[k + 1]], code[:, k]
            a = np.divide(s[c, rows], n[c] - 1, out=np.zeros(len(ids)), where=n[c] > 1)
            s[c, rows] = np.inf
            b = np.full(len(ids), np.inf)
            for at in range(0, len(n), 256):
                np.minimum(b, (s[at:at + 256] / n[at:at + 256, None]).min(axis=0), out=b)
            most = np.maximum(a, b)
            fine = (n[c] > 1) & np.isfinite(b) & (most > 0)
            silhouettes.append(np.divide(b - a, most, out=np.zeros(len(ids)), where=fine))
        for k, attempt in enumerate(attempts):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), attempt, dtype=np.int32)), pa.array(ids),
                                              pa.array(clusters[:, k].astype(np.int32)), pa.array(silhouettes[reps[k]])], [ATTEMPT, "id", "cluster_id", "silhouette"])
    return run


def silhouette_samples(vectors: DataFrame, labels: DataFrame, id_col: str = "id",
                       vec_col: str = "embedding", block_rows: int | None = None) -> DataFrame:
    """E1 for every attempt: ``(param_idx, id, cluster_id, silhouette)`` (Euclidean).

    ``a`` = mean distance to the other members of the own cluster, ``b`` = the
    smallest mean distance to another cluster, ``s = (b - a) / max(a, b)``;
    0 for singletons, a single cluster and when ``max(a, b) = 0``.  Noise is an ordinary cluster.
    """
    return packed_silhouettes(Packed(vectors, labels, id_col, vec_col), block_rows).withColumnRenamed("id", id_col)


def packed_silhouettes(packed: Packed, block_rows: int | None = None) -> DataFrame:
    """:func:`silhouette_samples` of packed attempts; attempts share a pass as far as their clusters' sums fit a task."""
    parts, first = [], 0
    cores = packed.rows.sparkSession.sparkContext.defaultParallelism
    while first < len(packed.attempts):
        stop, total, reps = first + 1, packed.counts[first], [first]
        while stop < len(packed.attempts):  # an attempt that equals the one before costs nothing
            more = 0 if packed.repeats[stop] else packed.counts[stop]
            if total + more > SUMS_PER_TASK // 1024:
                break
            reps += [stop] if more else []
            total, stop = total + more, stop + 1
        of = [sum(r <= k for r in reps) - 1 for k in range(first, stop)]
        most = block_rows or max(16, min(OWN_ROWS, SUMS_PER_TASK // max(total, 1)))
        blocks = ceil(packed.n_rows / most)
        blocks = max(ceil(blocks / cores) * cores if blocks > cores and not block_rows else blocks, min(cores, ceil(packed.n_rows / 128)), 1)
        home = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
        rows = packed.rows.select("id", "embedding", F.array(*[F.col("codes")[r] for r in reps]).alias("codes"), F.slice("clusters", first + 1, stop - first).alias("clusters"))
        own = rows.select(home.alias("_blk"), F.lit(True).alias("_own"), F.lit(0).cast("long").alias("_run"), "*")
        every = rows.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_blk"), F.lit(False).alias("_own"), F.xxhash64("codes").alias("_run"),
                            "id", "embedding", "codes", F.lit(None).cast("array<int>").alias("clusters"))
        full = every.join(F.broadcast(own.select("_blk").distinct()), "_blk", "left_semi")  # no block without rows of its own
        dealt = own.unionByName(full).repartition("_blk").sortWithinPartitions("_blk", F.desc("_own"), "_run")
        parts.append(dealt.groupBy("_blk").applyInArrow(_fold([packed.counts[r] for r in reps], packed.attempts[first:stop], of),
                                                        f"{ATTEMPT} int, id long, cluster_id int, silhouette double"))
        first = stop
    if not parts:
        return packed.sizes.where(F.lit(False)).select(F.col(ATTEMPT).cast("int").alias(ATTEMPT), F.lit(0).cast("long").alias("id"),
                                                       F.col("cluster_id").cast("int").alias("cluster_id"), F.lit(0.0).alias("silhouette"))
    return reduce(DataFrame.unionByName, parts)


def vector_sums(packed: Packed) -> DataFrame:
    """``(param_idx, cluster_id, size, center ARRAY<DOUBLE>)``: a task keeps the sums of its clusters and emits one row for each.

    Where a task meets more clusters than it may keep, it emits what it has and goes on.
    """
    offsets = np.concatenate([[0], np.cumsum(packed.counts)]).astype(np.int64)[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums, n = np.zeros(0, dtype=np.int64), None, np.zeros(0)

        def out() -> pa.RecordBatch:
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * sums.shape[1], pa.int32()), pa.array(sums.ravel()))
            return pa.RecordBatch.from_arrays([pa.array(held), pa.array(n.astype(np.int64)), flat], ["at", "n", "sums"])
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x, code = _flat(part, "embedding"), _flat(part, "codes") + offsets
                known, place = np.unique(code, return_inverse=True)
                place = place.reshape(code.shape)
                fresh, count = np.zeros((len(known), x.shape[1])), np.bincount(place.ravel(), minlength=len(known))
                for k in range(code.shape[1]):
                    np.add.at(fresh, place[:, k], x)
                if sums is not None and len(held) + len(known) > CLUSTERS_PER_TASK:
                    yield out()
                    sums = None
                if sums is None:
                    held, sums, n = known, fresh, count
                    continue
                every = np.union1d(held, known)
                more, both = np.zeros((len(every), x.shape[1])), np.zeros(len(every))
                for ids, s, c in ((held, sums, n), (known, fresh, count)):
                    more[np.searchsorted(every, ids)] += s
                    both[np.searchsorted(every, ids)] += c
                held, sums, n = every, more, both
        if sums is not None:
            yield out()

    def add(key: tuple, group: pa.Table) -> pa.Table:
        n = pc.sum(group.column("n")).as_py()
        total = pc.list_flatten(group.column("sums").combine_chunks()).to_numpy(zero_copy_only=False).reshape(group.num_rows, -1).sum(axis=0)
        return pa.table({"at": [key[0].as_py()], "center": pa.array([total / n], pa.list_(pa.float64()))})

    centers = packed.rows.mapInArrow(run, "at long, n long, sums array<double>").groupBy("at").applyInArrow(add, "at long, center array<double>")
    firsts = F.element_at(F.map_from_arrays(F.array(*[F.lit(a) for a in packed.attempts]), F.array(*[F.lit(int(o)) for o in offsets])), F.col(ATTEMPT))
    numbered = packed.sizes.withColumn("at", (firsts + F.col("code")).cast("long"))
    return numbered.join(centers, "at").select(ATTEMPT, "cluster_id", "size", "code", "center")


def centroids(vectors: DataFrame, labels: DataFrame, key_cols: list[str] | None = None,
              id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """``(key.., cluster_id, center ARRAY<DOUBLE>)``: per-dimension means; ``key_cols`` is none or the attempt.

    At most one row per task and cluster is shuffled, so a hot cluster never gathers its rows.
    """
    k = list(key_cols or [])
    tried = labels if k else labels.withColumn(ATTEMPT, F.lit(0))
    packed = Packed(vectors.join(tried.select(id_col).distinct(), id_col, "left_semi"), tried, id_col, vec_col)
    return vector_sums(packed).select(*k, "cluster_id", "center")


def davies_bouldin(vectors: DataFrame, labels: DataFrame, id_col: str = "id",
                   vec_col: str = "embedding", block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """E4 per attempt: ``(param_idx, davies_bouldin)``.

    ``S_k`` = mean distance of members to their centroid; score = mean over k
    of ``max_j (S_k + S_j) / d(c_k, c_j)`` with zero centroid distances treated
    as infinite; 0.0 when all S or all centroid distances are (close to) zero.
    """
    return packed_davies_bouldin(Packed(vectors, labels, id_col, vec_col), block_rows)


def packed_davies_bouldin(packed: Packed, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """:func:`davies_bouldin` of packed attempts; the vectors are read where they are while the centroids are few enough to broadcast."""
    from sextant.functions.vectors import euclidean

    k = [ATTEMPT]
    cents = cut_lineage(vector_sums(packed))
    attempts = F.array(*[F.lit(a) for a in packed.attempts])
    members = packed.rows.select("embedding", F.explode(F.arrays_zip(attempts.alias(ATTEMPT), F.col("codes").alias("code"))).alias("l"))
    members = members.select("embedding", F.col(f"l.{ATTEMPT}").alias(ATTEMPT), F.col("l.code").alias("code"))
    spread = (members.join(bounded_broadcast(cents.select(ATTEMPT, "code", "cluster_id", "center"), CLUSTERS_PER_TASK), k + ["code"])
              .groupBy(*k, "cluster_id").agg(F.avg(euclidean(F.col("embedding"), F.col("center"))).alias("S")))
    spread = cut_lineage(spread)
    c = cents.join(spread, k + ["cluster_id"])

    def kernel(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        d = euclidean_matrix(stack(left["center"]), stack(right["center"]))
        if same:
            np.fill_diagonal(d, 0.0)  # a centroid's distance to itself is exactly 0
        sa, sb = left["S"].to_numpy(), right["S"].to_numpy()
        with np.errstate(divide="ignore", invalid="ignore"):
            r = np.where(d == 0, 0.0, (sa[:, None] + sb[None, :]) / np.where(d == 0, 1.0, d))
        parts = [pd.DataFrame({"cluster_id": left["cluster_id"].to_numpy(), "r": r.max(1), "dmax": d.max(1)})]
        if not same:
            parts.append(pd.DataFrame({"cluster_id": right["cluster_id"].to_numpy(), "r": r.max(0),
                                       "dmax": d.max(0)}))
        return pd.concat(parts, ignore_index=True)

    pair = pairwise_apply(c.select(*k, "cluster_id", "center", "S"), "cluster_id", k, kernel,
                          "cluster_id int, r double, dmax double", block_rows)
    per_cluster = pair.groupBy(*k, "cluster_id").agg(F.max("r").alias("r"), F.max("dmax").alias("dmax"))
    per_attempt = (per_cluster.join(spread, k + ["cluster_id"]).groupBy(*k)
                   .agg(F.avg("r").alias("db"), F.max(F.abs("S")).alias("smax"), F.max("dmax").alias("dmax")))
    db = F.when((F.col("smax") <= ALLCLOSE_ATOL) | (F.col("dmax") <= ALLCLOSE_ATOL), F.lit(0.0)).otherwise(F.col("db"))
    return per_attempt.select(*k, db.alias("davies_bouldin"))


def score_attempts(vectors: DataFrame, labels: DataFrame, lam: float = 0.5, id_col: str = "id",
                   vec_col: str = "embedding", block_rows: int | None = None) -> DataFrame:
    """``(param_idx, n_clusters, silhouette, balanced, davies_bouldin)`` for all attempts.

    Degenerate attempts (E5) are not scored: -inf for silhouette and balanced,
    +inf for Davies-Bouldin.
    """
    labels = cut_lineage(labels.select(ATTEMPT, F.col(id_col).alias("id"), "cluster_id"))
    summary = attempt_summary(labels, [ATTEMPT])
    good = labels.join(summary.where(~F.col("degenerate")).select(ATTEMPT), ATTEMPT, "left_semi")
    packed = Packed(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("embedding")), good)
    sil = packed_silhouettes(packed, block_rows).groupBy(ATTEMPT).agg(F.avg("silhouette").alias("silhouette"))
    pen = size_penalty(good, lam, [ATTEMPT])
    db = packed_davies_bouldin(packed) if packed.attempts else sil.select(ATTEMPT, F.lit(0.0).alias("davies_bouldin"))
    out = (summary.join(sil, ATTEMPT, "left").join(pen, ATTEMPT, "left").join(db, ATTEMPT, "left"))
    ninf, pinf = F.lit(float("-inf")), F.lit(float("inf"))
    return out.select(
        ATTEMPT, F.col("n_clusters").cast("long").alias("n_clusters"),
        F.when(F.col("degenerate"), ninf).otherwise(F.col("silhouette")).alias("silhouette"),
        F.when(F.col("degenerate"), ninf).otherwise(F.col("silhouette") - F.col("penalty")).alias("balanced"),
        F.when(F.col("degenerate"), pinf).otherwise(F.col("davies_bouldin")).alias("davies_bouldin"))


def best_attempt(scores: DataFrame, measures=("silhouette", "balanced", "davies_bouldin"),
                 key_cols: list[str] | None = None) -> DataFrame:
    """Per measure the best attempt (max, or min for Davies-Bouldin); ties -> first index."""
    k = list(key_cols or [])
    outs = []
    for m in measures:
        sign = 1.0 if HIGHER_IS_BETTER[m] else -1.0
        best = scores.groupBy(*k).agg(F.max(F.struct((F.col(m) * sign).alias("v"),
                                                     (-F.col(ATTEMPT)).alias("ni"))).alias("b"))
        outs.append(best.select(*k, F.lit(m).alias("measure"), (-F.col("b.ni")).cast("int").alias(ATTEMPT),
                                (F.col("b.v") * sign).alias("score")))
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out


def alignment_check(vectors: DataFrame, labels: DataFrame, id_col: str = "id") -> DataFrame:
    """Per attempt, ids missing on either side (both must be 0 for a valid attempt).

    An attempt none of whose ids has a vector still has its row.
    """
    lab_ids = labels.select(ATTEMPT, id_col).withColumn("_g", F.lit(0))
    vec_ids = vectors.select(id_col)
    extra = (lab_ids.join(vec_ids, id_col, "left_anti").groupBy(ATTEMPT)
             .agg(F.count(F.lit(1)).alias("labels_without_vector")))
    matched = (lab_ids.join(vec_ids, id_col, "left_semi").groupBy(ATTEMPT, "_g")
               .agg(F.countDistinct(id_col).alias("_matched")))
    n_vec = vec_ids.agg(F.countDistinct(id_col).alias("_nv")).withColumn("_g", F.lit(0))
    every = labels.select(ATTEMPT).distinct().withColumn("_g", F.lit(0))
    out = every.join(n_vec, "_g").join(matched.drop("_g"), ATTEMPT, "left").join(extra, ATTEMPT, "left")
    return out.select(ATTEMPT,
                      F.coalesce("labels_without_vector", F.lit(0)).cast("long").alias("labels_without_vector"),
                      (F.col("_nv") - F.coalesce("_matched", F.lit(0))).cast("long").alias("vectors_without_label"))
