"""Connected components: local spanning forests, then randomised contraction.

A level first thins the edges: each task reduces a bounded number of edges to
a star per component that it sees.  If more than one task's worth is left,
every node moves to the neighbour (or itself) with the least hash of this
level, and the edges are mapped to where their ends went.  A hash that is
drawn anew per level removes a constant share of the nodes in expectation on
any graph, also on long chains with ordered ids, so the number of levels
grows with the logarithm of the edges; there is no limit on them.  The driver
sees one count per level, never the graph.  Every level is checkpointed into
the session's shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.session import BROADCAST_ROW_LIMIT, cut_lineage

#: Edges that one task joins up.
EDGES_PER_TASK = 500_000


def node_side(df: DataFrame, small: bool) -> DataFrame:
    """Broadcast a per-node table when the node count was proven small."""
    return F.broadcast(df) if small else df


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1, the smallest node of each one's component under the edges (i, j)."""
    label = np.arange(n)
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _forest(edges: DataFrame, k: list[str], tasks: int) -> DataFrame:
    """``(key.., id, root)`` per node that is not its own root, among the edges of each task."""
    id_type = edges.schema["i"].dataType.simpleString()
    fields = [f"{c} {edges.schema[c].dataType.simpleString()}" for c in k]

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = [b.to_pandas() for b in batches]
        if not frames or not sum(map(len, frames)):
            return
        e = pd.concat(frames, ignore_index=True)
        ends = pd.concat([e[[*k, "i"]].rename(columns={"i": "id"}), e[[*k, "j"]].rename(columns={"j": "id"})], ignore_index=True)
        nodes = ends.drop_duplicates().sort_values([*k, "id"], ignore_index=True)  # smaller id, smaller number
        number = ends.merge(nodes.assign(number=np.arange(len(nodes))), on=[*k, "id"], how="left")["number"].to_numpy()
        label = least_labels(len(nodes), number[:len(e)], number[len(e):])
        nodes["root"] = nodes["id"].to_numpy()[label]
        moved = nodes[label != np.arange(len(nodes))]
        yield pa.RecordBatch.from_pandas(moved, preserve_index=False)

    dealt = edges.coalesce(1) if tasks == 1 else edges.repartition(tasks, "i")
    return dealt.select(*k, "i", "j").mapInArrow(join_up, ", ".join([*fields, f"id {id_type}", f"root {id_type}"]))


def connected_components(nodes: DataFrame, edges: DataFrame, key_cols: list[str] | None = None, id_col: str = "id",
                         n_nodes: int | None = None, edges_per_task: int | None = None) -> DataFrame:
    """``(key.., id, root)`` where ``root`` is the smallest id of the node's component.

    ``nodes``: ``(key.., id)``; ``edges``: undirected ``(key.., i, j)`` over those nodes.
    ``key_cols`` separate independent graphs (e.g. one per sweep run) that are
    solved together in the same jobs.  ``n_nodes`` may pass a known node count.
    """
    k = list(key_cols or [])
    per_task = edges_per_task or EDGES_PER_TASK
    if n_nodes is None:
        n_nodes = nodes.count()
    small = n_nodes <= BROADCAST_ROW_LIMIT
    e = cut_lineage(edges.where(F.col("i") != F.col("j"))
                    .select(*k, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct())
    n_edges, moves, contracted = e.count(), [], False
    while n_edges:
        tasks = -(-n_edges // per_task)
        forest = cut_lineage(_forest(e, k, tasks))
        if tasks == 1:
            moves.append(forest)
            break
        draw = F.lit(len(moves))
        ends = forest.select(*k, F.col("id").alias("a"), F.col("root").alias("b"))
        ends = ends.unionByName(ends.select(*k, F.col("b").alias("a"), F.col("a").alias("b")))
        least = ends.groupBy(*k, "a").agg(F.min(F.struct(F.xxhash64(draw, "b").alias("h"), "b")).alias("least"))
        move = cut_lineage(least.where(F.col("least.h") < F.xxhash64(draw, "a"))
                           .select(*k, F.col("a").alias("id"), F.col("least.b").alias("root")))
        moves.append(move)
        contracted = True
        to = node_side(move, small)
        mapped = forest
        for end in ("id", "root"):
            at = to.select(*k, F.col("id").alias(end), F.col("root").alias("_to"))
            mapped = mapped.join(at, k + [end], "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
        e = cut_lineage(mapped.where(F.col("id") != F.col("root"))
                        .select(*k, F.least("id", "root").alias("i"), F.greatest("id", "root").alias("j")).distinct())
        n_edges = e.count()
    labels = nodes.select(*k, F.col(id_col).alias("id"), F.col(id_col).alias("root"))
    for move in moves:
        to = node_side(move.select(*k, F.col("id").alias("root"), F.col("root").alias("_to")), small)
        labels = labels.join(to, k + ["root"], "left").select(*k, "id", F.coalesce("_to", "root").alias("root"))
    if contracted:  # a place where nodes meet need not be their smallest id
        labels = cut_lineage(labels)
        least = labels.groupBy(*k, "root").agg(F.min("id").alias("_least"))
        labels = labels.join(node_side(least, small), k + ["root"]).select(*k, "id", F.col("_least").alias("root"))
    return cut_lineage(labels).withColumnRenamed("id", id_col)
