"""N-gram Jaccard join as a join in the Jaccard metric space.

Distances are one less similarity, a metric on shingle sets; with a radius r,
documents link at distance r at most.  Unrelated documents are all at distance
one of each other, where no pivot can tell them apart, so regions come from
pivots that a document shares something with:

* *Pivots.*  A set's shingles are dealt into more parts than two linked sets
  can differ in, so linked sets have equal parts (by size class, as sizes
  within the radius are at most one class apart).  Among the sets that share a
  part, the least is a pivot, and every linked pair lies in a region together.
* *Regions.*  Sets gather around their pivots; a set near several is a member
  of each.  A region that is too large is dealt out to the Voronoi cells of
  new pivots from it; the triangle inequality says which members are near
  enough to a border (2 r further from a pivot than from their own) to be
  replicated.  That recurs; what it can't make smaller is dealt into pairs of
  blocks.
* *Join.*  Inside a region, members within r of the pivot are joined by it.
  The others become pivots in turn, and meet only members whose distance from
  the first pivot differs by r at most, whose folded sets (a contraction) are
  near enough, and that are not joined yet.  What is left is compared exactly.

A region yields a spanning forest of its links, so groups of thousands of near
copies give rows in proportion to their members; components follow.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import as_bytes, by_bytes, byte_groups, give_back, result_schema, stored
from sextant.llm.wordhash import mix, run_hashes, word_hashes
from sextant.operators.components import connected_components
from sextant.session import bounded_broadcast

U64 = np.uint64
#: Members and bytes of a region that one join sees.
REGION_ROWS, REGION_BYTES = 2048, 24 << 20
#: Bytes of sets that leave a worker together.
FETCH_BYTES = 4 << 20
#: New pivots of a region that is too large.
SPLIT_PIVOTS = 8
#: Rows of (id, key) pairs that may be broadcast.
MEMBER_ROWS = 200_000


class Radius:
    """Similarity num / den, and what follows from it for sizes and differences."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.r = num, den, 1 - num / den
        bounds = [1, 2]  # first sizes of the classes: two classes on, sizes are out of reach
        while bounds[-1] < 1 << 40:
            bounds.append(max(bounds[-1] + 1, den * (bounds[-1] - 1) // num + 1))
        self.bounds = bounds

    def links(self, common, a, b):
        return self.den * common >= self.num * (a + b - common)

    def size_class(self, n: int) -> int:
        return bisect_right(self.bounds, n) - 1

    def most_different(self, n: int) -> int:
        """Shingles in one only of a set of n and any set linked with it."""
        return (self.den - self.num) * n // self.num

    def parts(self, c: int) -> int:
        """Parts for pairs whose larger size class is c: more than they can differ in."""
        most = self.most_different(self.bounds[c + 1] - 1)
        return most + 1 + max(1, most // 8)


def shingles(text: bytes, n: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; lower-case A-Z, words between ASCII white space."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=U64)
    s = np.sort(run_hashes(word_hashes(b" ".join(words)), min(n, len(words))))
    return s[np.append(True, s[1:] != s[:-1])]


def part_keys(s: np.ndarray, radius: Radius) -> np.ndarray:
    """Keys of parts of the set: two linked sets that differ have one in common.

    Of the parts, in an order that all sets share, one more than linked sets
    can differ in is enough.  Parts of many shingles come first, empty ones
    last: a part of one shingle recurs wherever that phrase does, and gathers
    sets that have nothing else in common.  Sets that nothing else can link
    with give none.
    """
    n = len(s)
    enough = radius.most_different(n) + 1
    if enough < 2:
        return np.empty(0, dtype=U64)
    out, own = [], radius.size_class(n)
    spread = mix(s)
    for c in (own, own + 1):
        k = radius.parts(c)
        part = (mix(s ^ U64(c * 0x5851F42D + 1)) % U64(k)).astype(np.int64)
        total = np.zeros(k, dtype=U64)
        np.add.at(total, part, spread)
        key = mix(total + U64(0x632BE59BD9B4E019) * (np.arange(k, dtype=U64) + U64(c << 32)))
        out.append(key[np.lexsort((key, -np.bincount(part, minlength=k)))[:enough]])
    return np.concatenate(out)


def _digests(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return tuple(int(mix(np.array([mix(s * U64(m)).sum(dtype=U64) + U64(len(s))]))[0].view(np.int64)) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def _common(s: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of s with each of the sets that lie in ``values``."""
    at = np.searchsorted(s, values)
    at[at == len(s)] = 0
    return np.add.reduceat((s[at] == values).astype(np.int64), starts)


def region_forest(sets: list[np.ndarray], radius: Radius) -> list[tuple[int, int]]:
    """Links that join up the region's members as all their links would; the first member is the pivot.  No set is empty."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    common = _common(sets[0], np.concatenate(sets), starts)
    near = radius.links(common, sizes, sizes[0])
    distance = 1 - common / (sizes + sizes[0] - common)
    links = [(0, int(i)) for i in np.flatnonzero(near) if i]
    group = np.where(near, 0, np.arange(len(sets)))
    outside = np.flatnonzero(~near)
    if not len(outside):
        return links
    fold = 64 if np.median(sizes) < 512 else 256
    folded = np.stack([np.bincount((s & U64(fold - 1)).astype(np.int64), minlength=fold) for s in sets]).astype(np.int32)
    waiting = np.ones(len(sets), dtype=bool)
    for q in outside.tolist():
        waiting[q] = False
        maybe = np.flatnonzero(waiting & (group != group[q]) & (np.abs(distance - distance[q]) <= radius.r + 1e-9)
                               & (radius.den * sizes >= radius.num * sizes[q]) & (radius.num * sizes <= radius.den * sizes[q]))
        if not len(maybe):
            continue
        apart = np.abs(folded[maybe] - folded[q]).sum(axis=1)  # at most the symmetric difference
        maybe = maybe[(radius.den + radius.num) * apart <= (radius.den - radius.num) * (sizes[maybe] + sizes[q])]
        for i in maybe.tolist():
            if group[i] != group[q]:
                small, large = (sets[i], sets[q]) if sizes[i] < sizes[q] else (sets[q], sets[i])
                if radius.links(int(_common(large, small, np.array([0]))[0]), sizes[i], sizes[q]):
                    links.append((q, i))
                    group[group == group[i]] = group[q]
    return links


def _split(regions: DataFrame, large: DataFrame, radius: Radius) -> tuple[DataFrame, DataFrame]:
    """The regions that new pivots can cut, and the members of these pivots' Voronoi cells of new pivots: each in its own cell, and near a border in the next ones too."""
    tasks = F.greatest(F.lit(1), F.ceil(F.col("rows") / REGION_ROWS)).cast("int")
    inside = regions.join(large.select("region", "rows", tasks.alias("tasks")), "region")
    chance = F.pmod(F.xxhash64("region", "d1", "d2"), F.lit(1 << 30)) / (1 << 30) * F.col("rows")
    pivots = (inside.where(chance < 8 * SPLIT_PIVOTS)  # a few for each region, whatever its size
              .withColumn("j", F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64("d2", "region"), "d1")))
              .where(F.col("j") <= SPLIT_PIVOTS)
              .select(F.col("region").alias("of"), "j", F.col("s").alias("pivot"),
                      F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("part")))
    members = inside.select("region", F.pmod(F.xxhash64("d1", "d2"), F.col("tasks")).cast("int").alias("task"), "d1", "d2", "s")

    def near(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """(member, pivot number) for each cell that a member belongs to or borders on."""
        sets = [np.frombuffer(b, dtype=U64) for b in left.column("s").to_pylist()]
        points = [np.frombuffer(b, dtype=U64) for b in right.column("pivot").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        together = np.concatenate(sets)
        d = np.empty((len(sets), len(points)))
        for k, p in enumerate(points):
            common = _common(p, together, starts)
            d[:, k] = 1 - common / (sizes + len(p) - common)
        row, cell = np.nonzero(d <= d.min(axis=1, keepdims=True) + 2 * radius.r + 1e-9)
        return row, right.column("j").to_numpy()[cell]

    def count(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        j = near(left, right)[1] if len(left) and len(right) else np.zeros(len(left), dtype=np.int64)
        j, n = np.unique(j, return_counts=True)
        return pa.table({"parent": pa.array([key[0].as_py()] * len(j), pa.int64()), "j": pa.array(j, pa.int32()), "n": pa.array(n, pa.int64())})

    def cells(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        row, j = near(left, right)
        region = mix(U64(key[0].as_py() & 0xFFFFFFFFFFFFFFFF) + j.astype(U64) * U64(0x9E3779B97F4A7C15)).view(np.int64)
        return left.select(["d1", "d2", "s"]).take(pa.array(row)).add_column(0, "region", pa.array(region))

    # where cells and borders would be no smaller than the region, it is not cut
    counts = (members.groupBy("region", "task").cogroup(pivots.groupBy("of", "part")).applyInArrow(count, "parent long, j int, n long")
              .groupBy("parent", "j").agg(F.sum("n").alias("n")).groupBy("parent").agg(F.sum("n").alias("total"), F.max("n").alias("most")))
    good = stored(large.join(counts, F.col("region") == F.col("parent")).where("total <= 2 * rows and most <= 0.8 * rows").select("region"), "good")
    cut = (members.join(good, "region", "left_semi").groupBy("region", "task")
           .cogroup(pivots.join(good.withColumnRenamed("region", "of"), "of", "left_semi").groupBy("of", "part"))
           .applyInArrow(cells, "region long, d1 long, d2 long, s binary"))
    return good, cut


def _sizes(regions: DataFrame) -> DataFrame:
    return regions.groupBy("region").agg(F.count("*").alias("rows"), F.sum(F.octet_length("s")).alias("bytes"))


def _by_size(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of consecutive items of at most ``limit`` bytes, or of one item."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, limit + (ends[at - 1] if at else 0), side="right")))
        yield at, to
        at = to


def _too_large(sizes: DataFrame) -> DataFrame:
    return sizes.where((F.col("rows") > REGION_ROWS) | (F.col("bytes") > REGION_BYTES))


def _bounded_regions(regions: DataFrame, radius: Radius) -> DataFrame:
    """Regions that one task can join, which hold every linked pair that the given ones hold."""
    done = []
    while True:  # cells are smaller than what they are cut from, so this ends
        large = stored(_too_large(_sizes(regions)), "large")
        if large.isEmpty():
            break
        good, cells = _split(regions, large, radius)
        if good.isEmpty():
            break
        done.append(regions.join(good, "region", "left_anti"))
        regions = stored(cells, "cells")
    done.append(regions)
    regions = done[0]
    for part in done[1:]:
        regions = regions.unionByName(part)
    sizes = _sizes(regions)
    blocks = F.greatest(F.ceil(2 * F.col("rows") / REGION_ROWS), F.ceil(2 * F.col("bytes") / REGION_BYTES)).cast("int")
    large = _too_large(sizes).select("region", blocks.alias("blocks"))
    rest = regions.join(large, "region", "left")
    block = F.pmod(F.xxhash64(F.lit("block"), "d1", "d2"), F.col("blocks")).cast("int")
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = rest.withColumn("block", F.coalesce(block, F.lit(0))).withColumn("other", other)
    region = F.when(F.col("blocks").isNull(), F.col("region")).otherwise(
        F.xxhash64("region", F.least("block", "other"), F.greatest("block", "other")))
    return paired.select(region.alias("region"), "d1", "d2", "s")


def jaccard_components(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text",
                       keep: list[str] | None = None, group_col: str | None = None) -> DataFrame:
    """``(keep or id .., n_shingles, component_id[, group_col])`` per row; texts link where similarity is at least num / den.

    Shingles are ``n`` words, or the whole sequence of a shorter text.  Rows
    without words (null, empty or white space) have 0 shingles, link with
    nothing and are their own component.  Repeated rows and copies link as
    equal sets.  ``component_id`` is the smallest id (an integer) that links
    reach; null ids are passed over, and where there is no other it is null.
    ``group_col`` names a number that the rows of one component share and no
    others, whatever their ids; it is null for rows without words.
    Texts of any length count whole; an empty table gives an empty result;
    columns not in ``keep`` are not read.
    """
    kept = keep or [id_col]
    radius = Radius(num, den)
    names = [f"c{k}" for k in range(len(kept))]
    given = docs.select(*[F.col(c).alias(m) for c, m in zip(kept, names)], F.col(id_col).cast("long").alias("id"),
                        F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            sets = [shingles(t or b"", n) for t in as_bytes(batch.column(batch.num_columns - 1))]
            ids = [_digests(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([len(s) for s in sets], pa.int64()), pa.array([x[0] for x in ids], pa.int64()),
                 pa.array([x[1] for x in ids], pa.int64())], [*names, "id", "th", "n", "d1", "d2"])

    described = stored(given.mapInArrow(describe, result_schema(given, {m: m for m in [*names, "id", "th"]}, "n long, d1 long, d2 long")), "sets")
    classes = (described.where("n > 0").groupBy("d1", "d2")
               .agg(F.min("id").alias("least"), F.min(F.struct("id", "th")).alias("first"), F.max("n").alias("n")))
    classes = stored(classes.select("d1", "d2", "n", "least", F.col("d1").alias("node"), "first"), "classes")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()  # sets whose keys this task has given out: copies need no more
        for batch in by_bytes(batches, "text"):
            texts = as_bytes(batch.column(0))
            for i, j in byte_groups(texts, 4 << 20):
                d1, parts = [], []
                for t in texts[i:j]:
                    s = shingles(t or b"", n)
                    digest = _digests(s)
                    if digest not in seen:
                        d1.append(digest[0])
                        parts.append(part_keys(s, radius))
                        if len(seen) < 1 << 18:
                            seen.add(digest)
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64)),
                                                      pa.array(np.repeat(np.array(d1), [len(p) for p in parts]))], ["key", "d1"])
        seen.clear()
        give_back()

    shared = given.select("text").mapInArrow(keys, "key long, d1 long").withColumn("region", F.min("d1").over(Window.partitionBy("key")))
    others = stored(shared.where("region <> d1").select("region", "d1").distinct(), "members")
    members = others.union(others.select("region", "region").distinct())
    sized = members.join(classes.select("d1", "n", "first"), "d1")
    sizes = sized.groupBy("region").agg(F.count("*").alias("rows"), (8 * F.sum("n")).alias("bytes"))
    size = sizes.agg(F.sum("bytes")).first()[0] or 0
    wanted = sized.groupBy("first").agg(F.collect_set("region").alias("regions"))  # fewer regions than keys
    wanted = bounded_broadcast(wanted.select(F.col("first.id").alias("wid"), F.col("first.th").alias("wth"), "regions"), MEMBER_ROWS)
    texts = given.select("id", "th", "text").join(wanted, F.col("id").eqNullSafe(F.col("wid")) & (F.col("th") == F.col("wth")))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            given_texts, regions = as_bytes(batch.column(0)), batch.column(1).to_pylist()
            for i, j in byte_groups(given_texts, 2 << 20):
                sets = [shingles(t or b"", n) for t in given_texts[i:j]]
                of = np.repeat(np.arange(j - i), [len(r) for r in regions[i:j]])
                ids = np.array([_digests(s) for s in sets], dtype=np.int64)[of]
                region, blobs = np.array([x for r in regions[i:j] for x in r], dtype=np.int64), [s.tobytes() for s in sets]
                for a, b in _by_size(np.array([len(x) for x in blobs])[of], FETCH_BYTES):  # a set goes to many regions
                    yield pa.RecordBatch.from_arrays([pa.array(region[a:b]), pa.array(ids[a:b, 0]), pa.array(ids[a:b, 1]),
                                                      pa.array([blobs[k] for k in of[a:b].tolist()], pa.binary())], ["region", "d1", "d2", "s"])

    regions = texts.select("text", "regions").mapInArrow(fetch, "region long, d1 long, d2 long, s binary")
    large = stored(_too_large(sizes), "large")
    if not large.isEmpty():
        cut = _bounded_regions(stored(regions.join(large.select("region"), "region", "left_semi"), "regions"), radius)
        regions = regions.join(large.select("region"), "region", "left_anti").unionByName(cut)

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by([("region", "ascending"), ("d1", "ascending"), ("d2", "ascending")])
        region, d1, d2 = (table.column(c).to_numpy() for c in ("region", "d1", "d2"))
        new = np.ones(len(region), dtype=bool)  # a row that came twice counts once
        new[1:] = (region[1:] != region[:-1]) | (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
        region, d1, d2 = region[new], d1[new], d2[new]
        blobs = table.column("s").filter(pa.array(new)).to_pylist()
        ends = np.append(np.flatnonzero(region[1:] != region[:-1]) + 1, len(region))
        a, b, at = [], [], 0
        for end in ends.tolist():
            for i, j in region_forest([np.frombuffer(x, dtype=U64) for x in blobs[at:end]], radius):
                a.append(at + i)
                b.append(at + j)
            at = end
        give_back()
        return pa.table({"a1": d1[a], "a2": d2[a], "b1": d1[b], "b2": d2[b]}) if a else empty

    empty = pa.table({c: pa.array([], pa.int64()) for c in ("a1", "a2", "b1", "b2")})
    tasks = max(1, size // (4 << 20))
    links = (regions.groupBy(F.pmod(F.xxhash64("region"), F.lit(tasks)).alias("task")).applyInArrow(
        lambda t: join(t.select(["region", "d1", "d2", "s"])), "a1 long, a2 long, b1 long, b2 long").distinct())
    node = classes.select("d1", "d2", "node")
    edges = (links.join(node.select(F.col("d1").alias("a1"), F.col("d2").alias("a2"), F.col("node").alias("i")), ["a1", "a2"])
             .join(node.select(F.col("d1").alias("b1"), F.col("d2").alias("b2"), F.col("node").alias("j")), ["b1", "b2"]).select("i", "j"))
    edges = stored(edges, "links")
    linked = edges.select(F.col("i").alias("id")).union(edges.select("j")).distinct()
    found = connected_components(linked, edges).withColumnRenamed("id", "node")
    least = classes.join(found, "node").groupBy("root").agg(F.min("least").alias("component"))
    joined = found.join(least, "root").select("node", "root", "component")
    labels = classes.join(joined, "node", "left").select("d1", "d2", F.coalesce("component", "least").alias("component"),
                                                         F.coalesce("root", "node").alias("group"))
    out = described.join(labels, ["d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(*[F.col(m).alias(c) for m, c in zip(names, kept)], F.col("n").alias("n_shingles"), component.alias("component_id"),
                      *([F.col("group").alias(group_col)] if group_col else []))
