"""Best-fit decreasing packing of tokenised documents into fixed-length sequences.

Pieces of one length are interchangeable, so the plan needs only how many
pieces each length has: at most ``capacity`` numbers, whatever the corpus.
The plan takes lengths from long to short and finds the tightest open bin
with a segment tree over remaining capacities, as piece-by-piece best-fit
decreasing would; bins with the same history move together as a run.  Every
piece then learns its place from its rank among the pieces of its length.
Ranks are counted in buckets and added up, so no length is one task's work.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import by_bytes, byte_groups, give_back, stored
from sextant.llm.tokenizing import id_encoder

#: Pieces that one ranking task should see.
RANK_ROWS = 50_000


class RemainingTree:
    """Segment tree over remaining capacities: which ones have an open bin, tightest first."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)

    def mark(self, remaining: int, is_open: bool) -> None:
        i = self.size + remaining
        self.any[i] = is_open
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, length: int) -> int | None:
        """The smallest marked capacity of at least ``length``."""
        i = self.size + length
        if self.any[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over ``{length: pieces}``, for runs of equal lengths and equal bins.

    Each row ``(length, rank_from, rank_to, first_bin, per_bin, base)`` places
    the pieces of that length with rank in [rank_from, rank_to): the piece
    with rank ``k`` is number ``(k - rank_from) % per_bin`` of its length in
    bin ``first_bin + (k - rank_from) // per_bin``, whose pieces of this
    length begin at ``base``.
    """
    plan, n_bins, tree = [], 0, RemainingTree(capacity)
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # remaining capacity -> (first bin, bins)

    def put(remaining: int, first: int, n: int) -> None:
        if n:
            runs[remaining].append((first, n))
            if len(runs[remaining]) == 1:
                tree.mark(remaining, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            remaining = tree.tightest(length)
            if remaining is None:  # open as many bins as this length needs
                remaining, first = capacity, n_bins
                n = -(-left // (capacity // length))
                n_bins += n
            else:
                first, n = runs[remaining].pop()
                if not runs[remaining]:
                    tree.mark(remaining, False)
            per_bin = remaining // length
            here = min(left, n * per_bin)
            plan.append((length, rank, rank + here, first, per_bin, capacity - remaining))
            full, part = divmod(here, per_bin)
            put(remaining - per_bin * length, first, full)
            put(remaining - part * length, first + full, 1 if part else 0)
            put(remaining, first + full + bool(part), n - full - bool(part))
            rank, left = rank + here, left - here
    return plan


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int | None, id_col: str, text_col: str,
                 batch_bytes: int = 1 << 20, give_up: bool = False) -> DataFrame:
    """``(id, piece, start, length, ids_crc32)`` of every document's token ids; ``give_up``: a task leaves no encoder in its worker."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = id_encoder(tokenizer_path)
        end = b"" if end_id is None else np.asarray([end_id], dtype="<u4").tobytes()
        for batch in by_bytes(batches, "text"):
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            row, piece, start, length, crc = [], [], [], [], []
            for i, j in byte_groups(texts, batch_bytes):
                for k, blob in enumerate(encoder.ids(texts[i:j]), i):
                    blob += end
                    n = len(blob) // 4
                    first = n if n <= capacity else n % capacity or capacity
                    at = 0
                    for number, to in enumerate(range(first, n + 1, capacity) if n else ()):
                        row.append(k)
                        piece.append(number)
                        start.append(at)
                        length.append(to - at)
                        crc.append(zlib.crc32(blob[4 * at:4 * to]))
                        at = to
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])
        if give_up:
            del encoder
            id_encoder.cache_clear()
            give_back()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, f"id {id_type}, piece int, start long, length long, ids_crc32 long")


def best_fit_pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int | None = 2,
                  id_col: str = "doc_id", text_col: str = "text", give_up: bool = False) -> DataFrame:
    """``(id, piece, start, length, ids_crc32, sequence_id, offset)`` per piece.

    A document is its ids and then ``end_id``; one of more than ``capacity``
    ids is cut into pieces of ``capacity``, of which the first may be shorter.
    Sequences hold at most ``capacity`` ids, without gaps, under the fewest
    sequences that best-fit decreasing finds.  A null or empty text is its
    end token alone (no piece at all without an ``end_id``); repeated rows
    and null ids are packed row by row; an empty table gives an empty result;
    other columns are not read.  With ``give_up`` workers keep no encoder between
    tasks, so that other work has their memory.
    """
    pieces = stored(token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, give_up=give_up), "pieces")
    spark = docs.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    buckets = max(1, sum(counts.values()) // RANK_ROWS)
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets)))
    before = (rows.groupBy("length", "bucket").count()
              .withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count"))
              .drop("count"))
    ranked = (rows.withColumn("n", F.row_number().over(Window.partitionBy("bucket", "length").orderBy("id", "piece")))
              .join(before, ["length", "bucket"])
              .withColumn("rank", F.col("before") + F.col("n") - 1))
    plan = spark.createDataFrame(best_fit_plan(counts, capacity), "length long, rank_from long, rank_to long, "
                                 "first_bin long, per_bin long, base long")
    placed = ranked.join(F.broadcast(plan), "length").where("rank >= rank_from and rank < rank_to")  # bounded by capacity
    nth = F.col("rank") - F.col("rank_from")
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
                         (F.col("first_bin") + F.floor(nth / F.col("per_bin"))).alias("sequence_id"),
                         (F.col("base") + nth % F.col("per_bin") * F.col("length")).alias("offset"))
