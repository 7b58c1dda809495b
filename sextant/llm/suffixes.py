"""Suffix-array deduplication by backward extension of intervals up to a minimum length.

Equal byte strings of the minimum length have the same anchor, the least of
the byte grams inside them.  Texts are dealt into chunks; anchors that recur
in the corpus bring the places that have them together, one shard for all
places of an anchor, with the bytes that their strings can cover.

In a shard the places are sorted by what follows the anchor, which gives the
suffix array and the common prefixes of its neighbours.  Then all intervals
are extended backwards breadth-first: the preceding bytes (the Burrows-Wheeler
transform) carry each suffix to its rank one byte earlier, and a neighbour's
common prefix is one more than the least between the two before.  Values grow
by one a step and stop at the minimum length: what reaches it is an interval
of equal strings.  All but the earliest of an interval are marked, byte by
byte, in their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from sextant.llm.common import as_bytes, by_bytes, byte_groups, give_back, result_schema, stored
from sextant.llm.phrases import _count
from sextant.llm.wordhash import U64, anchors, mix, run_hashes, sliding
from sextant.session import bounded_broadcast

#: Bytes of an anchor; of text of one chunk, about; of text hashed together; of strings in one shard, about.
GRAM, CHUNK_BYTES, GROUP_BYTES, SHARD_BYTES = 32, 2 << 20, 1 << 18, 6 << 20
#: Places of one anchor that one interval tree takes; more are cut into blocks, which their strings' hashes join up.
ANCHOR_ROWS = 4096
_BYTE = np.random.default_rng(41).integers(1, 1 << 63, 256, dtype=np.uint64)


def _recurring_phrases(counts: DataFrame) -> DataFrame:
    """``(chunk, phrase)`` of phrases that occur at least twice in all; summed, a phrase has one row per chunk."""
    per_chunk = counts.groupBy("chunk", "phrase").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("phrase"))
    return per_chunk.withColumn("total", total).where("total > 1").select("chunk", "phrase")


def _grams(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all grams, places of anchors, first byte of each text) of the texts one behind the other."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    hashes = run_hashes(_BYTE[np.frombuffer(b"".join(texts), dtype=np.uint8)], gram)
    tails = np.minimum(sizes, gram - 1)
    at = anchors(hashes, length - gram + 1, np.stack([sizes - tails, tails], axis=1).ravel())
    return hashes, at, np.cumsum(sizes) - sizes


def _owners(hashes: np.ndarray, at: np.ndarray, first: np.ndarray, sizes: np.ndarray, length: int, gram: int,
            wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor number, first start, last start) for every stretch of strings whose leftmost least gram is a wanted anchor."""
    nothing = (np.empty(0, dtype=np.int64),) * 3
    n = np.maximum(sizes - length + 1, 0)
    if not n.any():
        return nothing
    least = sliding(hashes, length - gram + 1, np.minimum)
    # runs of starts of one text with the same least value
    new = np.flatnonzero(least[1:] != least[:-1]) + 1
    begin = np.unique(np.concatenate((first[n > 0], new)))
    last = np.append(begin[1:] - 1, len(least) - 1)
    text = np.searchsorted(first, begin, side="right") - 1
    inside = begin < first[text] + n[text]
    begin, last = begin[inside], np.minimum(last, first[text] + n[text] - 1)[inside]
    out = []
    while len(begin):
        value = least[begin]
        owner = np.searchsorted(at, begin)
        while True:  # the first anchor from the start on that is the least
            wrong = hashes[at[owner]] != value
            if not wrong.any():
                break
            owner[wrong] += 1
        keep = wanted[owner]
        begin, last, owner = begin[keep], last[keep], owner[keep]
        out.append((owner, begin, np.minimum(last, at[owner])))
        beyond = last > at[owner]  # the value comes again before the run ends
        begin, last = at[owner][beyond] + 1, last[beyond]
    owner, begin, last = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(begin, kind="stable")
    return owner[order], begin[order], last[order]


def _known(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the sorted known ones."""
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def repeated_later(anchor: np.ndarray, rank: np.ndarray, left: np.ndarray, blobs: list[bytes], length: int
                   ) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Which strings of the shard's places also start at a place of lower rank.

    Place i has the bytes ``blobs[i]``, of which ``left[i]`` lie before its
    anchor; ``rank`` orders places.  Returns parallel (place, bytes before
    the anchor) of the repeated strings, and the classes' earliest ones.
    """
    n = len(anchor)
    sizes = np.array([len(b) for b in blobs], dtype=np.int64)
    flat = np.frombuffer(b"".join(blobs) + bytes(length), dtype=np.uint8)
    at = np.cumsum(sizes) - sizes + left  # the anchor's first byte
    right = np.minimum(sizes - left, length)
    after = np.lib.stride_tricks.sliding_window_view(flat, length)[at]
    after[np.arange(length) >= right[:, None]] = 0
    group = np.unique(anchor, return_inverse=True)[1].astype(np.uint32)
    # of those equal up to the zeros behind their stretch the shorter ones come first, as an end is less than any byte
    key = np.concatenate([group.astype(">u4").view(np.uint8).reshape(n, 4), after, right.astype(">u4").view(np.uint8).reshape(n, 4)], axis=1)
    order = np.argsort(np.ascontiguousarray(key).view(f"S{8 + length}").ravel(), kind="stable")
    # the common prefix of each suffix with the one before it, at most `length`
    lcp = np.zeros(n, dtype=np.int64)
    same = after[order[1:]] == after[order[:-1]]
    lcp[1:] = np.where(same.all(axis=1), length, same.argmin(axis=1))
    lcp[1:] = np.minimum(lcp[1:], np.minimum(right[order[1:]], right[order[:-1]]))
    lcp[1:][group[order[1:]] != group[order[:-1]]] = 0
    marked_place, marked_step, firsts = [], [], []
    step = 0
    while len(order):
        begin = np.flatnonzero(lcp < length)  # intervals of strings that agree to the minimum length
        least = np.minimum.reduceat(rank[order], begin)
        of = np.repeat(least, np.diff(np.append(begin, len(order))))
        later = order[rank[order] != of]
        if len(later):
            marked_place.append(later)
            marked_step.append(np.full(len(later), step))
        firsts.append((order[rank[order] == of], np.full(len(begin), step)))
        step += 1
        stay = left[order] >= step  # suffixes with a byte before them; the others leave, and their borders stay
        if not stay.any():
            break
        kept = np.flatnonzero(stay)
        lcp = np.minimum.reduceat(lcp[:kept[-1] + 1], np.append(0, kept[:-1] + 1))  # without what left behind the last kept
        order = order[kept]
        bwt = flat[at[order] - step]
        forward = np.argsort(bwt, kind="stable")  # ranks one byte earlier, within the anchor's group
        forward = forward[np.argsort(group[order][forward], kind="stable")]
        same = (bwt[forward[1:]] == bwt[forward[:-1]]) & (group[order][forward[1:]] == group[order][forward[:-1]])
        pair = np.flatnonzero(same)
        extended = np.zeros(len(order), dtype=np.int64)
        if len(pair):
            bounds = np.stack([forward[pair] + 1, forward[pair + 1] + 1], axis=1).ravel()
            between = np.minimum.reduceat(np.append(lcp, 0), bounds)[::2]
            extended[pair + 1] = np.minimum(between + 1, length)
        order, lcp = order[forward], extended
    nothing = np.empty(0, dtype=np.int64)
    return (np.concatenate(marked_place) if marked_place else nothing, np.concatenate(marked_step) if marked_step else nothing, firsts)


def _runs(starts: np.ndarray, length: int, by: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(by, begin, end) of the bytes covered by strings at ``starts``, stretch by stretch of the same ``by``."""
    order = np.lexsort((starts, by))
    starts, by = starts[order], by[order]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (by[1:] != by[:-1]) | (starts[1:] > starts[:-1] + length)
    at = np.flatnonzero(new)
    return by[at], starts[at], starts[np.append(at[1:] - 1, len(starts) - 1)] + length


def remove_repeated_bytes(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text",
                          chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256)`` per row.

    A byte goes if a string of ``length`` bytes that covers it also starts
    earlier: in a document with a smaller id, or earlier in the same one.
    Documents of one id but different texts come in the order of a hash of
    the text; rows equal in id and text are one document.  A null id comes
    before all others.  A null or empty text has no bytes; texts shorter than
    ``length`` keep all; an empty table gives an empty result; other columns
    are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n"), F.xxhash64(text).alias("th"))
    classes = stored(rows.groupBy("th", "n").agg(F.min("id").alias("least"), F.max(F.col("id").isNull()).alias("any_null")), "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    chunks = max(1, -(-total // chunk_bytes))
    chunked = rows.where(F.col("n") >= length).select(F.pmod(F.xxhash64(F.lit("chunk"), "th"), F.lit(chunks)).cast("int").alias("chunk"), "th", "text")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in by_bytes(batches, "text"):
            hashes = batch.column(1).to_pylist()
            keep = []
            for k, th in enumerate(hashes):
                if th not in seen:
                    keep.append(k)
                    if len(seen) < 1 << 19:
                        seen.add(th)
            yield batch.take(pa.array(keep, pa.int64()))

    texts = chunked.mapInArrow(once, "chunk int, th long, text string")  # copies within a task go once

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in once(batches):
            of_chunk, given = batch.column(0).to_numpy(), as_bytes(batch.column(2))
            for i, j in byte_groups(given, GROUP_BYTES):
                hashes, at, first = _grams(given[i:j], length, GRAM)
                which = np.searchsorted(first, at, side="right") - 1
                chunk, gram, n = _count([of_chunk[i:j][which], hashes[at].view(np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int32()), pa.array(gram), pa.array(n, pa.int64())], ["chunk", "phrase", "n"])

    recurring = _recurring_phrases(chunked.mapInArrow(count, "chunk int, phrase long, n long"))
    id_arrow = to_arrow_type(docs.schema[id_col].dataType)
    located = pa.schema([("least", id_arrow), ("any_null", pa.bool_()), ("chunk", pa.int32()), ("th", pa.int64()), ("text", pa.string()), ("anchors", pa.list_(pa.int64())),
                         ("places", pa.list_(pa.int32())), ("lefts", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32()))])

    def locate(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """The texts of the chunk that have recurring anchors, once each, and where these are."""
        grams = right.filter(pc.is_valid(right.column("phrase")))
        wanted = np.unique(grams.column("phrase").to_numpy())
        known = right.filter(pc.is_valid(right.column("th")))  # of all copies of a text the one of the least id counts
        rank_of = {th: k for k, th in enumerate(known.column("th").to_pylist())}
        least, any_null = known.column("least").to_pylist(), known.column("any_null").to_pylist()
        own = left.column("th").to_numpy()
        once_each = np.unique(own, return_index=True)[1]
        given = as_bytes(left.column("text").combine_chunks().take(pa.array(once_each)))
        out = {name: [] for name in located.names}
        for i, j in byte_groups(given, GROUP_BYTES):
            hashes, at, first = _grams(given[i:j], length, GRAM)
            sizes = np.array([len(t) for t in given[i:j]], dtype=np.int64)
            owner, a, b = _owners(hashes, at, first, sizes, length, GRAM, _known(hashes[at].view(np.int64), wanted))
            which = np.searchsorted(first, a, side="right") - 1
            for t, s in zip(*_bounds(which)):
                k = int(which[s.start])
                number = rank_of[int(own[once_each[i + k]])]
                out["least"].append(least[number])
                out["any_null"].append(any_null[number])
                out["chunk"].append(key[0].as_py())
                out["th"].append(int(own[once_each[i + k]]))
                out["text"].append(given[i + k])
                out["anchors"].append(hashes[at[owner[s]]].view(np.int64))
                out["places"].append((at[owner[s]] - first[k]).astype(np.int32))
                out["lefts"].append((at[owner[s]] - a[s]).astype(np.int32))
                out["sizes"].append((b[s] - a[s] + length).astype(np.int32))
        arrays = [pa.array(out[f.name], pa.binary()).cast(pa.string()) if f.name == "text" else pa.array(out[f.name], f.type) for f in located]
        return pa.Table.from_arrays(arrays, schema=located)

    chunk_of = F.pmod(F.xxhash64(F.lit("chunk"), "th"), F.lit(chunks)).cast("int").alias("chunk")
    known_texts = classes.where(F.col("n") >= length).select(chunk_of, "th", "least", "any_null")
    told = recurring.unionByName(known_texts, allowMissingColumns=True)
    touched = stored(texts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(locate, result_schema(
        docs, {"least": id_col}, "any_null boolean, chunk int, th long, text string, anchors array<long>, places array<int>, "
        "lefts array<int>, sizes array<int>")), "touched")
    # one row per place, with the bytes that its strings cover
    place_schema = result_schema(docs, {"least": id_col}, "any_null boolean, chunk int, th long, anchor long, place int, left int, s binary")

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            given, lists = as_bytes(batch.column("text")), [batch.column(c).to_pylist() for c in ("anchors", "places", "lefts", "sizes")]
            for i, j in byte_groups(given, GROUP_BYTES):
                of = np.repeat(np.arange(i, j), [len(x) for x in lists[0][i:j]])
                anchor, place, left, size = ([x for row in rows_[i:j] for x in row] for rows_ in lists)
                strings = [given[k][p - q:p - q + n] for k, p, q, n in zip(of.tolist(), place, left, size)]
                head = batch.select(["least", "any_null", "chunk", "th"]).take(pa.array(of))
                yield pa.RecordBatch.from_arrays([*head.columns, pa.array(anchor, pa.int64()), pa.array(place, pa.int32()),
                                                  pa.array(left, pa.int32()), pa.array(strings, pa.binary())], place_schema.names)

    places = touched.mapInArrow(slices, place_schema)
    n_bytes = touched.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda x, y: x + y))).first()[0] or 0
    shards = max(1, n_bytes // SHARD_BYTES)
    # an anchor with more places than one interval tree takes is cut into blocks by the text
    per_anchor = (touched.select(F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("rows"))
                  .where(F.col("rows") > ANCHOR_ROWS))
    blocks = stored(per_anchor.select("anchor", F.ceil(F.col("rows") / ANCHOR_ROWS).cast("int").alias("blocks")), "hot")
    shard = F.pmod(F.xxhash64("anchor", "block"), F.lit(shards)).cast("int")
    dealt = (places.join(bounded_broadcast(blocks), "anchor", "left")
             .withColumn("block", F.when(F.col("blocks").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(F.lit("block"), "th"), F.col("blocks")).cast("int")))
             .select(shard.alias("shard"), "block", "chunk", "th", "any_null", "least", "anchor", "place", "left", "s"))
    marked_schema = pa.schema([("chunk", pa.int32()), ("th", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()),
                               ("h", pa.int64()), ("g", pa.int64()), ("any_null", pa.bool_()), ("least", id_arrow)])

    def mark(table: pa.Table) -> pa.Table:
        table = table.sort_by([("any_null", "descending"), ("least", "ascending"), ("th", "ascending"), ("place", "ascending")])
        anchor, th, place, left, block = (table.column(c).to_numpy() for c in ("anchor", "th", "place", "left", "block"))
        tree = mix(anchor.view(U64) + U64(0x9E3779B97F4A7C15) * block.astype(U64))  # blocks of an anchor are trees of their own
        blobs = table.column("s").to_pylist()
        rank = np.arange(len(anchor))
        item, step, firsts = repeated_later(tree, rank, left.astype(np.int64), blobs, length)
        name = np.unique(th, return_inverse=True)[1]
        out = []
        if len(item):
            of, begin, end = _runs(place[item] - step, length, name[item])
            some = np.full(name.max() + 1, -1)
            some[name] = rank
            out.append(table.take(pa.array(some[of])).select(["chunk", "th", "any_null", "least"])
                       .append_column("begin", pa.array(begin, pa.int32())).append_column("end", pa.array(end, pa.int32()))
                       .append_column("h", pa.nulls(len(of), pa.int64())).append_column("g", pa.nulls(len(of), pa.int64())))
        if (block >= 0).any():  # the blocks' strings, the earliest of each, to be compared with those of the other blocks
            i, j = (np.concatenate(x) for x in zip(*firsts))
            whole = (block[i] >= 0) & (j <= left[i]) & (np.array([len(b) for b in blobs])[i] - left[i] + j >= length)
            i, j = i[whole], j[whole]
            strings = [blobs[a][left[a] - b:left[a] - b + length] for a, b in zip(i.tolist(), j.tolist())]
            digest = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in strings), dtype=np.int64).reshape(-1, 2)
            out.append(table.take(pa.array(i)).select(["chunk", "th", "any_null", "least"])
                       .append_column("begin", pa.array(place[i] - j, pa.int32())).append_column("end", pa.array(place[i] - j + length, pa.int32()))
                       .append_column("h", pa.array(digest[:, 0])).append_column("g", pa.array(digest[:, 1])))
        give_back()
        return pa.concat_tables([t.select(marked_schema.names).cast(marked_schema) for t in out]) if out else marked_schema.empty_table()

    marks = stored(dealt.groupBy("shard").applyInArrow(mark, StructType([
        *StructType.fromDDL("chunk int, th long, begin int, end int, h long, g long, any_null boolean"), *result_schema(docs, {"least": id_col}, "x int").fields[:1]])), "marks")
    sure = marks.where(F.col("h").isNull()).select("chunk", "th", "begin", "end")
    across = marks.where(F.col("h").isNotNull())
    earliest = across.groupBy("h", "g").agg(F.min(F.struct((~F.col("any_null")).alias("later"), "least", "th", "begin")).alias("e"))
    later = across.join(earliest, ["h", "g"]).where(~((F.col("th") == F.col("e.th")) & (F.col("begin") == F.col("e.begin")))).select("chunk", "th", "begin", "end")
    spans = sure.unionByName(later)
    kept = pa.schema([("th", pa.int64()), ("removed", pa.int64()), ("spans", pa.int64()), ("sha", pa.string())])

    def cut(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        own = right.column("th").to_numpy()
        order = np.argsort(own, kind="stable")
        own, begin, end = own[order], right.column("begin").to_numpy()[order], right.column("end").to_numpy()[order]
        out = {name: [] for name in kept.names}
        for th, data in zip(left.column("th").to_pylist(), as_bytes(left.column("text").combine_chunks())):
            a, b = np.searchsorted(own, th, "left"), np.searchsorted(own, th, "right")
            cover = np.zeros(len(data) + 1, dtype=np.int64)
            np.add.at(cover, begin[a:b], 1)
            np.add.at(cover, end[a:b], -1)
            gone = np.cumsum(cover)[:-1] > 0
            out["th"].append(th)
            out["removed"].append(int(gone.sum()))
            out["spans"].append(int((gone[1:] & ~gone[:-1]).sum() + gone[0]))
            out["sha"].append(hashlib.sha256(np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()).hexdigest())
        return pa.table(out, schema=kept)

    changed = (touched.select("chunk", "th", "text").groupBy("chunk").cogroup(spans.groupBy("chunk"))
               .applyInArrow(cut, "th long, removed long, spans long, sha string"))
    judged = classes.join(changed, "th", "left")
    same = F.when(F.col("id").isNull(), F.col("any_null")).otherwise(~F.col("any_null") & (F.col("id") == F.col("least")))
    later_copy = ~same & (F.col("n") >= length)  # every string of a later copy also starts in the first
    out = rows.select("id", "n", "th", F.sha2("text", 256).alias("whole")).join(judged, ["th", "n"])
    zero = F.lit(0).cast("long")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_bytes"),
        F.when(later_copy, F.col("n")).otherwise(F.coalesce("removed", zero)).alias("n_removed"),
        F.when(later_copy, F.lit(1).cast("long")).otherwise(F.coalesce("spans", zero)).alias("n_spans"),
        F.when(later_copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", "whole")).alias("kept_sha256"))


def _bounds(sorted_values: np.ndarray) -> tuple[np.ndarray, list[slice]]:
    """Distinct values of a sorted array, and where each stands."""
    if not len(sorted_values):
        return sorted_values, []
    at = np.append(0, np.flatnonzero(np.diff(sorted_values)) + 1)
    return sorted_values[at], [slice(a, b) for a, b in zip(at.tolist(), [*at[1:].tolist(), len(sorted_values)])]


