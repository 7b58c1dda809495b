"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations.

Every shard has virtual nodes on a ring of cells; the text of a row decides
its cell, and the next node clockwise the shard that would take it.  No shard
takes more rows than its share: what a full shard cannot take continues
clockwise to the next nodes whose shards have room.  Shares differ by one row
at most, so balance is exact, and rows move only where a share overflows.

Only the number of rows of each arc, one per virtual node, reaches the driver.
Rows learn their place in their arc by counting in buckets of bounded size, so
that an arc with a third of all rows (copies of one text) is many tasks' work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.llm.common import stored

CELLS = 1 << 16
#: Rows of an arc that one ranking task should see at most.
BUCKET_ROWS = 20_000


def ring_arcs(spark: SparkSession, n_shards: int, nodes_per_shard: int) -> list[tuple[int, int]]:
    """(last cell, shard) of every arc in clockwise order; of nodes on one cell, the first stays.

    A shard's nodes have the same cells however many shards there are.
    """
    nodes = (spark.range(n_shards * nodes_per_shard)
             .select(F.floor(F.col("id") / nodes_per_shard).cast("int").alias("shard"), F.pmod(F.xxhash64(F.lit("node"), "id"), F.lit(CELLS)).alias("cell"), "id")
             .groupBy("cell").agg(F.min_by("shard", "id").alias("shard")))
    return sorted((r["cell"], r["shard"]) for r in nodes.collect())


def bounded_walk(arcs: list[tuple[int, int]], counts: dict[int, int], n_shards: int) -> list[tuple[int, int, int, int, int]]:
    """``(arc, from, to, shard, first slot)`` pieces that give every shard its share of the rows.

    First each arc fills its own shard in ring order; then what was left of
    each arc, again in ring order, goes clockwise to the shards with room.
    """
    total = sum(counts.values())
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    used = [0] * n_shards
    plan, rest = [], []

    def take(arc: int, at: int, shard: int) -> int:
        n = min(counts[arc] - at, room[shard] - used[shard])
        if n:
            plan.append((arc, at, at + n, shard, used[shard]))
            used[shard] += n
        return at + n

    for arc, (_, shard) in enumerate(arcs):
        if counts.get(arc):
            at = take(arc, 0, shard)
            if at < counts[arc]:
                rest.append((arc, at))
    for arc, at in rest:
        step = arc
        while at < counts[arc]:
            step = (step + 1) % len(arcs)
            at = take(arc, at, arcs[step][1])
    if total and len({s for _, s in arcs}) < n_shards:
        raise ValueError("too few cells or virtual nodes: a shard has no node on the ring")
    return plan


def bounded_ring_shards(docs: DataFrame, n_shards: int = 24, nodes_per_shard: int = 64, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """``(id, size, text_crc32, law, shard, slot, grown_shard)`` per row under the law ``rows``.

    ``size`` is the text's UTF-8 bytes plus 8.  Equal texts share a cell and
    stay together but where their shard is full.  A null text counts as an
    empty one; null ids and repeated rows are dealt row by row (rows equal in
    id and text are interchangeable); an empty table gives an empty result;
    other columns are not read.
    """
    spark = docs.sparkSession
    arcs = ring_arcs(spark, n_shards, nodes_per_shard)
    # an arc's cells: after the arc before it up to its own; cells after the last node belong to the first arc
    spans = [(0, -1 if not k else arcs[k - 1][0], cell, k) for k, (cell, _) in enumerate(arcs)] + [(0, arcs[-1][0], CELLS - 1, 0)]
    cells = (spark.createDataFrame([(a + 1, b, k) for _, a, b, k in spans if a < b], "a long, b long, arc int")
             .select(F.explode(F.sequence("a", "b")).alias("cell"), "arc"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
                       F.crc32(text).alias("crc"), F.xxhash64(text).alias("place"))
    rows = stored(rows.withColumn("cell", F.pmod("place", F.lit(CELLS))).join(F.broadcast(cells), "cell"), "ring")  # CELLS rows
    counts = {r["arc"]: r["count"] for r in rows.groupBy("arc").count().collect()}  # one row per virtual node
    per_bucket = min(BUCKET_ROWS, max(64, sum(counts.values()) // len(arcs)))
    plan = bounded_walk(arcs, counts, n_shards)
    buckets = spark.createDataFrame([(k, -(-n // per_bucket)) for k, n in counts.items()], "arc int, buckets int")
    rows = (rows.join(F.broadcast(buckets), "arc")  # one row per virtual node
            .withColumn("bucket", F.pmod(F.xxhash64(F.lit("bucket"), "id"), F.col("buckets"))))
    before = (rows.groupBy("arc", "bucket").count()
              .withColumn("before", F.sum("count").over(Window.partitionBy("arc").orderBy("bucket")) - F.col("count")).drop("count"))
    placed = (rows.withColumn("n", F.row_number().over(Window.partitionBy("arc", "bucket").orderBy("place", "id", "size", "crc")))
              .join(before, ["arc", "bucket"]).withColumn("rank", F.col("before") + F.col("n") - 1))
    pieces = spark.createDataFrame(plan, "arc int, a long, b long, shard int, first long")
    # at most two pieces per virtual node and shard
    return (placed.join(F.broadcast(pieces), "arc").where("rank >= a and rank < b")
            .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard",
                    (F.col("first") + F.col("rank") - F.col("a")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
