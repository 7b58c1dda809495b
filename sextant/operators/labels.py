"""Cluster labelling.

One group-by covers all clusters at once; counts are pre-aggregated per
(cluster, candidate) before any ranking so the noise cluster, which may hold
most rows, shrinks to its distinct candidates first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions.vectors import cosine_similarity
from sextant.operators.candidates import keep_candidates
from sextant.operators.ordering import rank_in_groups, top_by_count
from sextant.session import bounded_broadcast

#: Centres that may be broadcast.
CENTER_ROWS = 20_000


def label_most_frequent(df: DataFrame, cluster_col: str = "cluster_id", id_col: str = "id",
                        candidate_col: str = "candidate_intent",
                        nulls_as_candidates: bool = False) -> DataFrame:
    """A1: per cluster, the most frequent kept candidate (tie: first occurrence); none -> ''.

    Returns ``(cluster_id, generated)`` for every cluster, the noise cluster included.
    """
    kept = keep_candidates(df, candidate_col, nulls_as_candidates)
    best = top_by_count(kept, [cluster_col], candidate_col, id_col, 1)
    clusters = df.select(cluster_col).distinct()
    return (clusters.join(best.select(cluster_col, F.col(candidate_col).alias("generated")),
                          cluster_col, "left")
            .select(cluster_col, F.coalesce("generated", F.lit("")).alias("generated")))


def top_candidates(df: DataFrame, n: int = 3, cluster_col: str = "cluster_id", id_col: str = "id",
                   candidate_col: str = "candidate_intent", sep: str = ", ") -> DataFrame:
    """A2 + T9: the ``n`` most frequent kept candidates per cluster, joined by ``", "``.

    Clusters without candidates get ''.
    """
    kept = keep_candidates(df, candidate_col)
    top = top_by_count(kept, [cluster_col], candidate_col, id_col, n)
    joined = top.groupBy(cluster_col).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", candidate_col))),
                                 lambda s: s[candidate_col]), sep).alias("candidates"))
    clusters = df.select(cluster_col).distinct()
    return (clusters.join(joined, cluster_col, "left")
            .select(cluster_col, F.coalesce("candidates", F.lit("")).alias("candidates")))


def majority_response(df: DataFrame, cluster_col: str = "cluster_id", order_col: str = "prompt_no",
                      response_col: str = "response") -> DataFrame:
    """A3: the most common response per cluster; ties go to the earliest prompt."""
    best = top_by_count(df, [cluster_col], response_col, order_col, 1)
    return best.select(cluster_col, F.col(response_col).alias("generated"))


def most_common(df: DataFrame, value_col: str, n: int, order_col: str = "id") -> DataFrame:
    """The ``n`` most common values over the whole table (a top-k report).

    ``orderBy(...).limit(n)`` plans as a distributed take-ordered: each task
    keeps its own top n, the driver merges n rows per task.
    """
    counts = df.groupBy(value_col).agg(F.count(F.lit(1)).alias("cnt"),
                                       F.min(order_col).alias(f"first_{order_col}"))
    top = counts.orderBy(F.col("cnt").desc(), F.col(f"first_{order_col}").asc()).limit(n)
    w = Window.orderBy(F.col("cnt").desc(), F.col(f"first_{order_col}").asc())
    return top.withColumn("rank", F.row_number().over(w))  # n rows only


def broadcast_labels(rows: DataFrame, labels: DataFrame, cluster_col: str = "cluster_id") -> DataFrame:
    """Attach each cluster's label to its rows.

    The label table has one row per cluster; the planner (with AQE runtime
    statistics) broadcasts it when small and shuffles otherwise.
    """
    return rows.join(labels, cluster_col, "left")


def centroid_similarity(vectors: DataFrame, centers: DataFrame, cluster_col: str = "cluster_id",
                        vec_col: str = "embedding", center_col: str = "center") -> DataFrame:
    """Cosine of every row with its own cluster centre; few centres are broadcast, so a hot cluster is not gathered."""
    joined = vectors.join(bounded_broadcast(centers.select(cluster_col, center_col), CENTER_ROWS), cluster_col)
    return joined.withColumn("cos_sim", cosine_similarity(F.col(vec_col), F.col(center_col)))


def order_by_centroid(sims: DataFrame, cluster_col: str = "cluster_id", id_col: str = "id",
                      sim_col: str = "cos_sim") -> DataFrame:
    """Rank members by similarity to the centre, desc; ties keep row order (id)."""
    return rank_in_groups(sims, [cluster_col], [F.col(sim_col).desc(), F.col(id_col).asc()])


def dedup_keep_first(df: DataFrame, cluster_col: str = "cluster_id", rank_col: str = "rank",
                     text_col: str = "text") -> DataFrame:
    """Distinct texts per cluster keeping the first (lowest rank) occurrence.

    A group-by with ``min`` (partial aggregation) rather than a window, so a
    hot cluster is not ranked in one task.
    """
    return df.groupBy(cluster_col, text_col).agg(F.min(rank_col).alias(rank_col))
