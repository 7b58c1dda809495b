"""Prompt packing and prompt-based labelling.

Packing is an ordered greedy fold per cluster: utterances are appended
while the filled template stays within 512 words.  A cluster may hold most
rows, so the fold goes over ranges of its rows that tasks take apart:

1. rows are dealt by (cluster, rank) ranges.  With prefix sums of the words,
   the place where a prompt that starts at a row would be full is a binary
   search, which gives every row its next start; pointer doubling closes
   these, so a range knows for every amount of words already in the open
   prompt (at most the budget) how many prompts it closes and how many words
   are open behind it: a table of budget + 1 entries;
2. the tables of a cluster's ranges are composed by doubling, which tells
   each range what is open before it;
3. each range marks its prompts' rows, and the at most two prompts that it
   shares with its neighbours are put together from their pieces.

The word arithmetic is done per utterance on the JVM side (word count, plus
one when the text is empty or ends in white space, because the ", " or "."
that follows it then stands alone as a word).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sextant.functions.text import LABEL_PROMPT_FIXED_WORDS, PROMPT_WORD_BUDGET, SPACE, render_label_prompt, word_count, words
from sextant.operators.inference import answer_prompts, first_candidate_responder
from sextant.operators.labels import majority_response, top_candidates
from sextant.session import BROADCAST_ROW_LIMIT, cut_lineage

#: Utterances of one range.
RANGE_ROWS = 200_000


class _Range:
    """One cluster's rows of one range: where prompts that start at a row end, by prefix sums and binary search."""

    def __init__(self, w: np.ndarray, cost: np.ndarray, filled: np.ndarray, used: int, budget: int):
        self.rows, self.budget = len(w), budget
        self.before = np.concatenate([[0], np.cumsum(cost)])  # words up to a row
        self.reach = self.before[:-1] + w  # never falls: a row's own words count in the rows behind it
        self.room = budget - used  # for the utterances of one prompt
        place = np.where(filled, np.arange(self.rows), self.rows)
        self.first = np.append(np.minimum.accumulate(place[::-1])[::-1], self.rows) if self.rows else np.array([0])

    def stop(self, words_before: np.ndarray) -> np.ndarray:
        """The first row that does not fit a prompt with so many words before the range."""
        return np.searchsorted(self.reach, self.room - words_before, side="right")

    def next_starts(self) -> np.ndarray:
        """Per row the start of the prompt after the one that starts there; empty utterances at a prompt's start leave nothing."""
        f = self.first[:-1]
        stop = np.searchsorted(self.reach, self.room + self.before[np.minimum(f, self.rows)], side="right")
        return np.where(f < self.rows, np.maximum(stop, f + 1), self.rows)

    def open_after(self, start: np.ndarray) -> np.ndarray:
        """Words in the prompt that starts at a row and is open at the end; 0 if it has only empty utterances."""
        f = self.first[start]
        return np.where(f < self.rows, np.minimum(self.before[-1] - self.before[np.minimum(f, self.rows)], self.budget), 0)

    def first_stop(self, state: np.ndarray) -> np.ndarray:
        """Where a prompt that comes with ``state`` words is full; with 0 words it starts in the range."""
        nothing = min(int(self.first[0]), self.rows)
        fresh = int(self.next_starts()[nothing]) if nothing < self.rows else self.rows
        return np.where(state == 0, fresh, self.stop(state))

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """For 0 to budget words that are open before the range: prompts closed in it and words open behind it."""
        jump = np.append(self.next_starts(), self.rows)
        closed = (jump < self.rows).astype(np.int64)
        last = np.arange(self.rows + 1)  # the start of the prompt that is open at the end
        step = jump.copy()
        last = np.where(closed > 0, step, last)
        while True:  # pointer doubling
            further = closed[last] > 0
            if not further.any():
                break
            closed = np.where(further, closed + closed[last], closed)
            last = np.where(further, last[last], last)
        state = np.arange(self.budget + 1)
        at = self.first_stop(state)
        full = at < self.rows
        at = np.minimum(at, self.rows)
        stays = np.where(state == 0, self.open_after(np.zeros(1, dtype=np.int64))[0] if self.rows else 0,
                         np.minimum(state + self.before[-1], self.budget))
        return np.where(full, 1 + closed[at], 0), np.where(full, self.open_after(last[at]), stays)


def _slices(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """One table for each range and cluster, whose rows come sorted."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).select(names).combine_chunks()
    keys = list(zip(table.column("range").to_pylist(), table.column("cluster_id").to_pylist()))
    starts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
    for a, b in zip(starts, starts[1:]):
        yield table.slice(a, b - a)


def _range_of(table: pa.Table, budget: int) -> _Range:
    w, extra, wc, filled = (table.column(c).to_numpy(zero_copy_only=False) for c in ("w", "extra", "wc", "filled"))
    return _Range(w.astype(np.int64), (w + extra).astype(np.int64), filled, 1 + LABEL_PROMPT_FIXED_WORDS + int(wc[0]), budget)


def _composed(tables: DataFrame) -> DataFrame:
    """``(cluster_id, range, prompt_no, state)``: prompts closed and words open before each range, by doubling over a cluster's ranges."""
    ranges = tables.groupBy("cluster_id").agg(F.max("place").alias("m")).agg(F.max("m")).first()[0] or 0
    through = tables.select("cluster_id", "range", "place", "closed", "open")
    step = 1
    while step <= ranges:  # a range's table becomes that of the 2, 4, 8 .. ranges up to it
        left = through.select("cluster_id", (F.col("place") + step).alias("place"), F.col("closed").alias("lc"), F.col("open").alias("lo"))
        both = through.join(left, ["cluster_id", "place"], "left")
        after = F.when(F.col("lo").isNull(), F.col("closed")).otherwise(F.zip_with("lc", "lo", lambda c, o: c + F.col("closed")[o.cast("int")]))
        state = F.when(F.col("lo").isNull(), F.col("open")).otherwise(F.transform("lo", lambda o: F.col("open")[o.cast("int")]))
        through = cut_lineage(both.select("cluster_id", "range", "place", after.alias("closed"), state.alias("open")))
        step *= 2
    before = through.select("cluster_id", (F.col("place") + 1).alias("place"), F.col("closed")[0].alias("prompt_no"), F.col("open")[0].alias("state"))
    return (through.select("cluster_id", "range", "place").join(before, ["cluster_id", "place"], "left")
            .select("cluster_id", "range", F.coalesce("prompt_no", F.lit(0)).alias("prompt_no"), F.coalesce("state", F.lit(0)).alias("state")))


def pack_prompts(utterances: DataFrame, candidates: DataFrame, cluster_col: str = "cluster_id",
                 rank_col: str = "rank", text_col: str = "text",
                 budget: int = PROMPT_WORD_BUDGET, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``(cluster_id, prompt_no, first_rank, last_rank, n_utterances, prompt)``.

    ``utterances``: ``(cluster_id, rank, text)``, taken in ``rank`` order;
    ``candidates``: ``(cluster_id, candidates)`` text put in every prompt of the cluster.
    The first utterance of a prompt is always taken, even when it alone
    exceeds the budget; empty ones before it leave nothing behind, not even a
    comma, but are counted.  A null text counts as an empty one.
    """
    candidates = cut_lineage(candidates.select(cluster_col, "candidates"))  # one row per cluster, read at both ends
    u = (utterances.select(F.col(cluster_col).alias("cluster_id"),
                           F.col(rank_col).cast("long").alias("rank"), F.coalesce(text_col, F.lit("")).alias("text"))
         .join(candidates.select(F.col(cluster_col).alias("cluster_id"), "candidates"),
               "cluster_id", "left")
         .withColumn("wc", word_count(F.coalesce("candidates", F.lit("")))).drop("candidates")
         .withColumn("w", word_count("text"))
         .withColumn("filled", F.length("text") > 0)
         .withColumn("extra", (~F.col("filled") | F.col("text").rlike(rf"{SPACE}\z")).cast("int")))
    u = cut_lineage(u)
    tasks = max(u.sparkSession.sparkContext.defaultParallelism, -(-u.count() // range_rows))
    ordered = cut_lineage(u.repartitionByRange(tasks, "cluster_id", "rank").sortWithinPartitions("cluster_id", "rank", "text")
                          .withColumn("range", F.spark_partition_id()))
    kind = to_arrow_type(ordered.schema["cluster_id"].dataType)
    ctype = ordered.schema["cluster_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _slices(batches, ["cluster_id", "w", "extra", "wc", "filled", "range"]):
            closed, left = _range_of(table, budget).table()
            yield pa.RecordBatch.from_arrays([table.column(0).slice(0, 1).combine_chunks(), table.column("range").slice(0, 1).combine_chunks().cast(pa.int32()),
                                              pa.array([closed], pa.list_(pa.int64())), pa.array([left], pa.list_(pa.int64()))],
                                             ["cluster_id", "range", "closed", "open"])

    tables = ordered.select("cluster_id", "w", "extra", "wc", "filled", "range").mapInArrow(
        measure, f"cluster_id {ctype}, range int, closed array<long>, open array<long>")
    tables = cut_lineage(tables)
    order = Window.partitionBy("cluster_id").orderBy("range")  # one row per range of a cluster
    places = tables.select("cluster_id", "range", (F.row_number().over(order) - 1).alias("place"))
    entry = cut_lineage(_composed(cut_lineage(tables.join(places, ["cluster_id", "range"]))))
    if entry.limit(BROADCAST_ROW_LIMIT + 1).count() <= BROADCAST_ROW_LIMIT:  # the ranges stay where and as they are
        begun = ordered.join(F.broadcast(entry), ["cluster_id", "range"])
    else:
        begun = (ordered.join(entry, ["cluster_id", "range"]).repartition(tasks, "range")
                 .sortWithinPartitions("range", "cluster_id", "rank", "text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _slices(batches, ["cluster_id", "rank", "text", "w", "extra", "wc", "filled", "range", "prompt_no", "state"]):
            span = _range_of(table, budget)
            state, no = table.column("state")[0].as_py(), table.column("prompt_no")[0].as_py()
            jump, cuts = span.next_starts(), [0]
            at = int(span.first_stop(np.array([state]))[0])
            while at < span.rows:
                cuts.append(at)
                at = int(jump[at])
            if len(cuts) > 1 and cuts[1] == 0:  # the open prompt was full before this range
                cuts, no, state = cuts[1:], no + 1, 0
            cuts.append(span.rows)
            rank, text = table.column("rank").to_numpy(), table.column("text").to_pylist()
            out = {c: [] for c in ("prompt_no", "first_rank", "last_rank", "n", "texts")}
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if a == b:
                    continue
                begin = a if k == 0 and state else min(int(span.first[a]), b)
                for c, v in zip(out, (no + k, int(rank[a]), int(rank[b - 1]), b - a, ", ".join(text[begin:b]) if begin < b else None)):
                    out[c].append(v)
            if out["n"]:
                yield pa.RecordBatch.from_arrays([pa.array([table.column(0)[0].as_py()] * len(out["n"]), kind), pa.array(out["prompt_no"], pa.int32()),
                                                  *(pa.array(out[c], pa.int64()) for c in ("first_rank", "last_rank", "n")), pa.array(out["texts"], pa.string())],
                                                 ["cluster_id", *out])

    pieces = begun.select("cluster_id", "rank", "text", "w", "extra", "wc", "filled", "range", "prompt_no", "state").mapInArrow(
        mark, f"cluster_id {ctype}, prompt_no int, first_rank long, last_rank long, n long, texts string")
    ordered_texts = F.transform(F.filter(F.array_sort(F.collect_list(F.struct("first_rank", "texts"))), lambda p: p["texts"].isNotNull()), lambda p: p["texts"])
    whole = pieces.groupBy("cluster_id", "prompt_no").agg(F.min("first_rank").alias("first_rank"), F.max("last_rank").alias("last_rank"),
                                                          F.sum("n").cast("int").alias("n_utterances"), F.array_join(ordered_texts, ", ").alias("texts"))
    named = whole.join(candidates.select(F.col(cluster_col).alias("cluster_id"), "candidates"), "cluster_id", "left")
    return named.select("cluster_id", "prompt_no", "first_rank", "last_rank", "n_utterances",
                        render_label_prompt("texts", F.coalesce("candidates", F.lit(""))).alias("prompt"))


def prompt_words(prompts: DataFrame) -> DataFrame:
    """Word count of every packed prompt (budget check)."""
    return prompts.withColumn("n_words", F.size(words("prompt")))


def label_by_prompt(df: DataFrame, generate: Callable = first_candidate_responder,
                    n_candidates: int = 3, cluster_col: str = "cluster_id", id_col: str = "id",
                    text_col: str = "text", candidate_col: str = "candidate_intent",
                    order: DataFrame | None = None, batch_size: int | None = None) -> DataFrame:
    """Top candidates -> packed prompts -> one answer per prompt -> majority answer.

    Utterances are taken in row (``id``) order with duplicates; pass ``order``
    ``(cluster_id, id, rank)`` (e.g. by closeness to a k-means centre, W1/W2) to
    change that.  ``batch_size``: see :func:`answer_prompts`.  Returns ``(cluster_id, generated)``.
    """
    cands = top_candidates(df, n_candidates, cluster_col, id_col, candidate_col)
    if order is None:
        utts = df.select(cluster_col, F.col(id_col).alias("rank"), text_col)
    else:
        utts = df.join(order, [cluster_col, id_col]).select(cluster_col, "rank", text_col)
    prompts = pack_prompts(utts, cands, cluster_col, "rank", text_col)
    answered = answer_prompts(prompts, generate, "prompt", "response", batch_size)
    best = majority_response(answered, "cluster_id", "prompt_no", "response")
    return best.select(F.col("cluster_id").alias(cluster_col), "generated")
