"""Exact deduplication against a minimal perfect hash of the digests seen before, in DataFrame operations.

The corpus has a history and rows that came later.  The distinct digests of
the history get gapless slots by a minimal perfect hash: a digest's hash gives
its bucket, the bucket holds a seed under which its few digests take different
places, and the buckets' sizes add up to the first slot of each.  Buckets for
which no seed is found are marked, and their digests are put into the buckets
of a further level.  A slot holds the full digest and the locator of the row
that wins its group.

The distinct digests of later rows are looked up: bucket, seed, slot, then all
bytes of the digest are compared.  Members join the slot's group, nonmembers
are groups of their own.

A group may hold any share of the rows: rows are counted by digest and salt
before digests meet, and results go back the same way, so that no task gets a
whole group.  Nothing but counts reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import stored

#: Characters that texts are compared without: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
#: Mean number of digests in a bucket, and the seeds that are tried, in so many steps.
BUCKET_KEYS, SEED_STEPS = 3, (0, 16, 64, 256)
#: Mean number of slots whose buckets are numbered by one task.
SHARD_SLOTS = 65_536


@dataclass(frozen=True)
class PerfectHash:
    """``buckets`` (level, bucket, size, seed, first) and ``slots`` (slot, digest and whatever else the keys came with)."""

    buckets: DataFrame
    slots: DataFrame
    level_buckets: tuple[int, ...]


def bucket_of(digest: Column, level: int, n_buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("bucket"), F.lit(level), digest), F.lit(n_buckets)).cast("long")


def place_of(digest: Column, seed: Column, size: Column) -> Column:
    """The digest's place, 0 to ``size`` - 1, in a bucket with that seed."""
    return F.pmod(F.xxhash64(seed.cast("int"), digest), size.cast("long"))


def _seed(keys: Column, level: int) -> Column:
    """The first of the level's seeds that gives the keys different places; null if none does."""
    base = level * SEED_STEPS[-1]  # what failed together is not tried again with the same seeds
    size = F.size(keys)

    def among(a: int, b: int) -> Column:
        fits = F.filter(F.sequence(F.lit(base + a), F.lit(base + b - 1)),
                        lambda seed: F.size(F.array_distinct(F.transform(keys, lambda k: place_of(k, seed, size)))) == size)
        return F.try_element_at(fits, F.lit(1))
    return F.coalesce(*[among(a, b) for a, b in zip(SEED_STEPS, SEED_STEPS[1:])])


def build_perfect_hash(keys: DataFrame) -> PerfectHash:
    """A minimal perfect hash of the distinct, non-null values of column ``digest``; other columns stay in the slots.

    No keys give tables without rows.  Buckets hold distinct hashed values, so
    none is large whatever the rows are; what has no seed after the first
    level is about a thirtieth of the keys, and as much again at each further
    level, until nothing is left.
    """
    n_keys = keys.count()
    rest, left, level, tables, sizes, placed = keys, n_keys, 0, [], [], []
    while left:
        n_buckets = -(-left // BUCKET_KEYS)
        here = rest.withColumn("bucket", bucket_of(F.col("digest"), level, n_buckets))
        found = here.groupBy("bucket").agg(F.collect_list("digest").alias("keys")).select(
            F.lit(level).alias("level"), "bucket", F.size("keys").alias("size"), _seed(F.col("keys"), level).alias("seed"))
        found = stored(found, "mph-buckets")
        tables.append(found)
        sizes.append(n_buckets)
        joined = here.join(found, "bucket")
        placed.append(joined.where("seed is not null"))
        failed = found.where("seed is null").agg(F.sum("size").alias("n")).first()["n"] or 0
        rest = stored(joined.where("seed is null").select(keys.columns), "mph-rest") if failed else None
        left, level = failed, level + 1
    if not n_keys:
        none = keys.where(F.lit(False))
        buckets = none.select(F.lit(0).alias("level"), F.lit(0).cast("long").alias("bucket"), F.lit(0).alias("size"), F.lit(0).alias("seed"),
                              F.lit(0).cast("long").alias("first"))
        return PerfectHash(buckets, none.withColumn("slot", F.lit(0).cast("long")), ())
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    shards = -(-n_keys // SHARD_SLOTS)
    seeded = every.withColumn("held", F.when(F.col("seed").isNotNull(), F.col("size")).otherwise(0))
    seeded = seeded.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "level", "bucket"), F.lit(shards)))
    inside = Window.partitionBy("shard").orderBy("level", "bucket")
    # one row per shard of 65,536 slots
    bases = seeded.groupBy("shard").agg(F.sum("held").alias("n")).withColumn(
        "base", F.sum("n").over(Window.orderBy("shard")) - F.col("n")).drop("n")
    buckets = (seeded.withColumn("inner", F.sum("held").over(inside) - F.col("held")).join(bases, "shard")
               .select("level", "bucket", "size", "seed", (F.col("base") + F.col("inner")).cast("long").alias("first")))
    buckets = stored(buckets, "mph")
    slots = None
    for part in placed:
        part = part.select(*keys.columns, "level", "bucket", place_of(F.col("digest"), F.col("seed"), F.col("size")).alias("place"))
        slots = part if slots is None else slots.unionByName(part)
    slots = (slots.join(buckets.select("level", "bucket", "first"), ["level", "bucket"])
             .select((F.col("first") + F.col("place")).alias("slot"), *keys.columns))
    return PerfectHash(buckets, stored(slots, "mph-slots"), tuple(sizes))


def look_up(index: PerfectHash, digests: DataFrame) -> DataFrame:
    """``digests`` with column ``slot``: where the perfect hash puts each ``digest``, null where its bucket is empty.

    A digest that is not among the keys may get a slot too: compare it with
    the slot's digest.  A digest of a marked bucket goes on to the next level.
    """
    todo, done = digests, []
    for level, n_buckets in enumerate(index.level_buckets):
        at = index.buckets.where(F.col("level") == level).select("bucket", "size", "seed", "first")
        at = todo.withColumn("bucket", bucket_of(F.col("digest"), level, n_buckets)).join(at, "bucket", "left")
        ended = at.where("seed is not null or size is null")
        done.append(ended.select(*digests.columns, (F.col("first") + place_of(F.col("digest"), F.col("seed"), F.col("size"))).alias("slot")))
        todo = at.where("seed is null and size is not null").select(digests.columns)
    if not done:
        return digests.withColumn("slot", F.lit(None).cast("long"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def exact_groups(rows: DataFrame) -> DataFrame:
    """``(digest, salt, n, best)`` per digest and salt, for groups of two rows and more: the group's size and its winner.

    ``rows``: ``(digest, salt, later, best)`` with ``best`` the struct by which
    the least row of a group wins.  Rows that are not ``later`` are the
    history, whose digests the perfect hash is built over.
    """
    salted = stored(rows.groupBy("digest", "salt", "later").agg(F.count("*").alias("n"), F.min("best").alias("best")), "salted")

    def by_digest(part: DataFrame) -> DataFrame:
        return part.groupBy("digest").agg(F.sum("n").alias("n"), F.min("best").alias("best"))

    index = build_perfect_hash(stored(by_digest(salted.where("not later")), "history"))
    at = look_up(index, stored(by_digest(salted.where("later")), "later"))
    seen = index.slots.select("slot", F.col("digest").alias("held"), F.col("n").alias("held_n"), F.col("best").alias("held_best"))
    no_slot = at.where("slot is null").drop("slot")
    looked = at.where("slot is not null").join(seen, "slot", "left")
    member = F.coalesce(F.col("held") == F.col("digest"), F.lit(False))
    looked = stored(looked.withColumn("member", member), "looked-up")
    joined = looked.where("member").select("digest", (F.col("n") + F.col("held_n")).alias("n"), F.least("best", "held_best").alias("best"))
    alone = looked.where("not member").select("digest", "n", "best").unionByName(no_slot)
    # slots that no later row belongs to keep their own group
    kept = index.slots.where("n > 1").select("digest", "n", "best").join(joined.select("digest"), "digest", "left_anti")
    groups = joined.unionByName(alone.where("n > 1")).unionByName(kept)
    return salted.select("digest", "salt").distinct().join(groups, "digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", history_share: float = 0.5) -> DataFrame:
    """``(id, keep_id, group_size, kept, text_sha256)`` per row; rows whose texts are equal without white space are a group.

    The row of a group with the most code points stays, of several the one of
    the smallest id (rows without an id come last), of rows that agree in both
    any one.  The history is the share of the rows with the smallest ids.

    A null text counts as an empty one, texts of white space alone equal it;
    texts are hashed whole, however long.  Rows without an id are later rows
    and have groups like all others; their ``keep_id`` is null if one of them
    stays.  Of repeated rows one is kept.  An empty table gives an empty
    result; other columns are not read.
    """
    spark = docs.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    border = docs.agg(F.percentile_approx(id_col, history_share, 1000).alias("at")).first()["at"]
    later = F.col(id_col).isNull() if border is None else F.coalesce(F.col(id_col) > F.lit(border), F.lit(True))
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), SPACES, text)  # bytes are copied, no character is decoded
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(bare, 256)).alias("digest"),
                       F.length(text).alias("chars"), later.alias("later"), F.monotonically_increasing_id().alias("locator"))
    rows = stored(rows, "digests").withColumn("salt", F.pmod("locator", F.lit(salts)).cast("int"))
    best = F.struct((-F.col("chars")).alias("chars"), F.col("id").isNull().alias("no_id"), "id", "locator")
    groups = exact_groups(rows.select("digest", "salt", "later", best.alias("best")))
    found = rows.join(groups, ["digest", "salt"], "left")
    return found.select(F.col("id").alias(id_col), F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
                        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
                        F.coalesce(F.col("best.locator") == F.col("locator"), F.lit(True)).alias("kept"),
                        F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_OP13 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST)
"""
