"""Ordering primitives shared by the operators.

* :func:`top_by_count`: per group, the values ranked by frequency with the
  first occurrence as tie-break (``Counter.most_common`` semantics).  Counts
  are pre-aggregated per (group, value) with map-side partial aggregation,
  so a hot group shrinks to its distinct values before any ranking.
* :func:`dense_index`: consecutive 0-based numbers for the distinct values
  of a column (within optional partition columns), in ascending order.  A
  small value set (checked) is ranked in one window; a large one is ranked
  distributed: range-partition, local positions, per-partition offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.session import BROADCAST_ROW_LIMIT, bounded_broadcast, cut_lineage


def top_by_count(df: DataFrame, group_cols: list[str], value_col: str, order_col: str,
                 n: int | None = 1, count_col: str = "cnt", rank_col: str = "rank") -> DataFrame:
    """Rank the values of each group by count desc, then by first ``order_col`` asc.

    Returns ``group_cols + [value_col, count_col, first_<order_col>, rank_col]``
    with ``rank <= n`` (all values when ``n`` is None).
    """
    first = f"first_{order_col}"
    counts = df.groupBy(*group_cols, value_col).agg(
        F.count(F.lit(1)).alias(count_col), F.min(order_col).alias(first))
    if n == 1:
        # Top-1 as a plain aggregate: partial aggregation all the way, skew-proof.
        best = counts.groupBy(*group_cols).agg(
            F.max(F.struct(F.col(count_col), (-F.col(first)).alias("neg_first"),
                           F.col(value_col))).alias("b"))
        return best.select(*group_cols, F.col(f"b.{value_col}").alias(value_col),
                           F.col(f"b.{count_col}").alias(count_col),
                           (-F.col("b.neg_first")).alias(first), F.lit(1).alias(rank_col))
    w = Window.partitionBy(*group_cols).orderBy(F.col(count_col).desc(), F.col(first).asc())
    ranked = counts.withColumn(rank_col, F.row_number().over(w))
    return ranked if n is None else ranked.where(F.col(rank_col) <= n)


def dense_index(df: DataFrame, col: str, out_col: str = "idx",
                part_cols: list[str] | None = None) -> DataFrame:
    """Map each distinct ``(part_cols, col)`` to its 0-based ascending position within ``part_cols``.

    Returns the distinct ``part_cols + [col, out_col]`` table (join it back on the caller side).
    """
    part = list(part_cols or [])
    d = df.select(*part, col).distinct()
    n = d.limit(BROADCAST_ROW_LIMIT + 1).count()
    if n <= BROADCAST_ROW_LIMIT:
        w = Window.partitionBy(*part).orderBy(col) if part else Window.orderBy(col)
        return d.withColumn(out_col, (F.row_number().over(w) - 1).cast("long"))
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = (d.repartitionByRange(parts, *part, col).sortWithinPartitions(*part, col)
          .withColumn("_pid", F.spark_partition_id())
          .withColumn("_mid", F.monotonically_increasing_id()))
    d = cut_lineage(d)  # the positions below must come from one fixed layout
    stats = d.groupBy("_pid", *part).agg(F.min("_mid").alias("_m0"), F.count(F.lit(1)).alias("_n"))
    wo = (Window.partitionBy(*part) if part else Window.partitionBy()).orderBy("_pid") \
        .rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_off", F.coalesce(F.sum("_n").over(wo), F.lit(0)))
    # stats holds at most (#partitions + #groups) rows.
    out = d.join(stats, ["_pid", *part])
    return out.select(*part, col, (F.col("_off") + F.col("_mid") - F.col("_m0")).cast("long").alias(out_col))


def rank_in_groups(df: DataFrame, group_cols: list[str], order: list[Column], out_col: str = "rank") -> DataFrame:
    """``df`` with each row's 1-based position in its group by ``order``, also where a group holds most rows.

    Range splitters over (group, order) deal a hot group to many tasks; each
    range counts its own rows, and the sizes of a group's earlier ranges, one
    row for each, are added.  ``order`` should leave no ties.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (df.repartitionByRange(parts, *group_cols, *order).sortWithinPartitions(*group_cols, *order)
             .withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    dealt = cut_lineage(dealt)  # positions come from one fixed layout
    spans = dealt.groupBy(*group_cols, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group_cols).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    ranked = dealt.join(bounded_broadcast(spans), [*group_cols, "_range"])
    return ranked.withColumn(out_col, (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("int")).select(*df.columns, out_col)
