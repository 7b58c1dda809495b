"""Approximate nearest neighbours by learned partitions.

A bounded sample gives a neighbour graph, which is cut into equal parts with
few edges between them.  A small network learns, from a vector, which parts
hold its neighbours.  Every row of the table goes to its most probable part;
a query goes to its several most probable ones, where all rows are compared
with it in double precision.  How many parts a query tries is measured on the
sample against brute force.  Parts are searched in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import stored, unit_hash

#: Rows and queries of one block.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 1024
#: Rows of the sample that a part needs.
PART_SAMPLE = 64


@dataclass(frozen=True)
class Router:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    @property
    def parts(self) -> int:
        return len(self.b2)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(_unit(x) @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` rows of largest inner product with each row, itself left out."""
    out = np.empty((len(x), k), dtype=np.int64)
    for a in range(0, len(x), 1024):
        s = x[a:a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a:a + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int, rng: np.random.Generator, slack: float = 1.05, rounds: int = 12) -> np.ndarray:
    """A part per node: halves by smoothed random values, then moves to neighbours' parts while these have room."""
    n = len(graph)
    label = np.zeros(n, dtype=np.int64)
    for _ in range(max(0, parts.bit_length() - 1)):  # parts is a power of two
        value = rng.standard_normal(n)
        for _ in range(20):
            value = 0.5 * value + 0.5 * value[graph].mean(axis=1)
            for p in np.unique(label):
                inside = label == p
                value[inside] = (value[inside] - value[inside].mean()) / (value[inside].std() + 1e-12)
        half = np.zeros(n, dtype=np.int64)
        for p in np.unique(label):
            inside = np.flatnonzero(label == p)
            half[inside[np.argsort(value[inside], kind="stable")[len(inside) // 2:]]] = 1
        label = 2 * label + half
    most = int(np.ceil(slack * n / parts))
    sizes = np.bincount(label, minlength=parts)
    around = np.concatenate([graph, np.zeros_like(graph)], axis=1)[:, :graph.shape[1]]
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        for column in around.T:
            np.add.at(votes, (np.arange(n), label[column]), 1)
            np.add.at(votes, (column, label), 1)
        gain = votes - votes[np.arange(n), label][:, None]
        moved = 0
        for i in np.argsort(-gain.max(axis=1), kind="stable"):
            to = int(gain[i].argmax())
            if gain[i, to] <= 0:
                break
            if sizes[to] < most:
                sizes[label[i]] -= 1
                sizes[to] += 1
                label[i] = to
                moved += 1
        if not moved:
            break
    return label


def train_router(x: np.ndarray, target: np.ndarray, rng: np.random.Generator, hidden: int = 128, epochs: int = 40) -> Router:
    """A one-hidden-layer network from vectors to ``target`` distributions over parts, by Adam."""
    d, parts = x.shape[1], target.shape[1]
    w = [rng.standard_normal((d, hidden)) * (2 / d) ** 0.5, np.zeros(hidden), rng.standard_normal((hidden, parts)) * hidden ** -0.5, np.zeros(parts)]
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    u = _unit(x) * d ** 0.5
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(u)), max(1, len(u) // 256)):
            h = np.maximum(u[rows] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            e = np.exp(z - z.max(axis=1, keepdims=True))
            g = (e / e.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            gh = (g @ w[2].T) * (h > 0)
            step += 1
            for k, grad in enumerate((u[rows].T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad ** 2
                w[k] = w[k] - 3e-3 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return Router(w[0] * d ** 0.5, w[1], w[2], w[3], parts)


def fit(x: np.ndarray, parts: int, k: int = 20, recall: float = 0.95, seed: int = 11) -> Router:
    """Partition the sample, train the router, and set ``probes`` to reach ``recall`` on rows it was not trained on."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x) - 1)
    if parts < 2 or k < 1:
        d = x.shape[1]
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    graph = neighbour_graph(x, k)
    label = balanced_parts(graph, parts, rng)
    target = np.zeros((len(x), parts))
    for column in graph.T:
        np.add.at(target, (np.arange(len(x)), label[column]), 1 / k)
    test = rng.random(len(x)) < 0.2
    router = train_router(x[~test], target[~test], rng)
    z = router.logits(x)
    home = z.argmax(axis=1)
    order = np.argsort(-z[test], axis=1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :], axis=1)
    needed = np.take_along_axis(rank, home[graph[test]], axis=1).ravel()  # probes until a neighbour's part is tried
    reached = np.cumsum(np.bincount(needed, minlength=parts)) / max(1, len(needed))
    probes = int(np.searchsorted(reached, recall) + 1)
    return Router(router.w1, router.b1, router.w2, router.b2, min(probes, parts))


def usable(vector: Column, dimension: int | None = None) -> Column:
    """Not null, not zero, without null or non-finite components, and of the given dimension."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vector, lambda v: v != 0)
    fine = vector.isNotNull() & F.coalesce(fine, F.lit(False))
    return fine if dimension is None else fine & (F.size(vector) == dimension)


def top_pairs(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` best candidates of each query in the block; equal scores by smaller id.  ``c_ids`` are distinct."""
    out = []
    s = q @ c.T
    s[q_ids[:, None] == c_ids[None, :]] = -np.inf
    least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
    for i in range(len(q)):
        at = np.flatnonzero((s[i] >= least[i] - 1e-9 * (1 + abs(least[i]))) & (s[i] > -np.inf))
        score = (q[i] * c[at]).sum(axis=1)  # summed alike wherever the row stands, so copies tie exactly
        best = np.lexsort((c_ids[at], -score))[:k]
        out.append(pd.DataFrame({"query_id": q_ids[i], "vec_id": c_ids[at][best], "score": score[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def part_count(total: int, sample: int) -> int:
    """A power of two about the square root of the rows, with at least ``PART_SAMPLE`` rows of the sample to a part."""
    parts = 1
    while 4 * parts * parts <= total and sample // (2 * parts) >= PART_SAMPLE:
        parts *= 2
    return parts


def learned_partition_search(vectors: DataFrame, every: int = 20, k: int = 20, sample_rows: int = 16_384,
                             recall: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` largest inner products found for each query.

    Queries are the rows whose id is divisible by ``every``; candidates all
    other ids.  Parts grow as the square root of the rows, as far as the
    sample, at most about ``sample_rows`` rows by a hash of the id, can
    tell them apart; every row is indexed.  A query whose parts hold fewer
    than ``k`` candidates searches all parts.  Null or zero vectors, those
    with null or non-finite components or of another length than most of the
    sample, and rows with a null id take no part.  Equal scores come by
    smaller id; a repeated row counts once, and of different vectors with one
    id the least (by its components in order) counts; with fewer than ``k`` candidates
    all are returned; an empty table gives an empty result.  Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    total = rows.count()
    sample = [r["v"] for r in rows.where(unit_hash("vec_id") < sample_rows / max(1, total)).orderBy("vec_id").limit(2 * sample_rows).collect()]
    if not sample:
        sample = [r["v"] for r in rows.limit(1).collect()]
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = [len(v) for v in sample]
    dimension = max(set(sizes), key=sizes.count)
    x = np.array([v for v in sample if len(v) == dimension])
    router = fit(x, part_count(total, len(x)), k, recall)
    shared = spark.sparkContext.broadcast(router)  # dimension x 128 weights
    rows = rows.where(F.size("v") == dimension)
    if not rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = shared.value
        for f in frames:
            if len(f):
                order = np.argsort(-r.logits(np.stack(f["v"].to_numpy())), axis=1)[:, :r.probes].astype(np.int32)
                yield f.assign(parts=list(order))

    routed = stored(rows.mapInPandas(route, "vec_id long, v array<double>, parts array<int>"), "routed")
    index = routed.select("vec_id", "v", F.col("parts")[0].alias("part"))
    asked = routed.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "parts")
    n_rows = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}  # one row per part
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def searched(queries: DataFrame) -> DataFrame:
        found = _search(index, queries.select("query_id", "q", F.explode("parts").alias("part")), n_rows, k)
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    enough = min(k, sum(n_rows.values()) - 1)
    found = stored(searched(asked), "found")
    full = found.where(F.col("rank") == max(1, enough)).select("query_id")
    short = asked.join(full, "query_id", "left_anti")
    if enough < 1 or router.probes >= router.parts or short.isEmpty():
        return found
    everywhere = short.withColumn("parts", F.array(*[F.lit(p) for p in sorted(n_rows)]))
    return found.join(full, "query_id", "left_semi").unionByName(searched(everywhere))


def _search(index: DataFrame, queries: DataFrame, n_rows: dict[int, int], k: int) -> DataFrame:
    """``(query_id, vec_id, score)``: the best of each block of a part for the queries ``(query_id, q, part)``."""
    spark = index.sparkSession
    n_queries = {r["part"]: r["count"] for r in queries.groupBy("part").count().collect()}  # one row per part
    blocks = spark.createDataFrame([(p, -(-n_rows[p] // BLOCK_ROWS), -(-n_queries.get(p, 0) // BLOCK_QUERIES)) for p in n_rows],
                                   "part int, nc int, nq int")

    def block(id_name: str, n: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(n), F.col(id_name)), F.col(n)).cast("int").alias("c" if n == "nc" else "r")

    def spread(n: str, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)

    small = F.broadcast(blocks)  # one row per part
    left = index.join(small, "part").where("nq > 0").select("part", block("vec_id", "nc"), spread("nq", "r"), "vec_id", "v")
    right = queries.join(small, "part").select("part", spread("nc", "c"), block("query_id", "nq"), "query_id", "q")

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        return top_pairs(np.stack(b["q"].to_numpy()), b["query_id"].to_numpy(), np.stack(a["v"].to_numpy()), a["vec_id"].to_numpy(), k)

    keys = ["part", "c", "r"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")
