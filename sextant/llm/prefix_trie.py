"""Prefix trie of conversations by truncation peeling.

A conversation is the path of its turns' digests.  Equal conversations are
merged first, counted before they meet.  The distinct paths are dealt in their
order, so that those with a common prefix are in one task, and each task peels
its part: from the greatest depth down, the conversations that end at a depth
join the nodes that survived from below, every node is finished and adds its
sums to the path without its last turn.

Only the nodes on a task's first and last path may go on in another task.
These two paths leave the task open, one record each with what their nodes
have gathered so far, and are dealt and peeled again with the open paths of
all tasks, a small part of the paths, until one task has them all.

Nodes whose parent was still open learn the parent's number afterwards.  The
ids of the conversations that end at a node, which may be a third of all, are
sorted over all tasks, written out in pieces, and hashed piece by piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import give_back, stored
from sextant.session import BROADCAST_ROW_LIMIT

#: Bytes of a turn's digest, and digits of the same.
WIDTH, DIGITS = 16, 32
#: Turns that one task should peel, and bytes of one piece of sorted ids.
TASK_TURNS, PIECE_BYTES = 65_536, 1 << 16
#: Borrowed first turns are at most so many.
MAX_HEAD = 5
#: Over so many tasks go the children of one node, where their parents are too many to broadcast.
PARENT_SALTS = 32

#: What a node gathers: members, the smallest of them, children, leaves and savings below, and of the conversations
#: that end there their number and the smallest one.
SUMS = ("n", "least", "children", "leaves", "saved", "ends", "first_end")
SMALLEST = ("least", "first_end")
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
#: A finished node with the keys by which it finds its hash, its parent and its children where these are not at hand,
#: or an open path with what its nodes of depth 0, 1, .. have gathered.
RECORD = pa.schema([
    ("node", pa.struct([*((c, pa.int64()) for c in NODE[:-1]), (NODE[-1], pa.string()), *((c, pa.binary()) for c in ("end_key", "parent_key", "own_key"))])),
    ("open", pa.struct([("path", pa.binary()), ("lens", pa.list_(pa.int32())), *((c, pa.list_(pa.int64())) for c in SUMS)]))])
RECORD_DDL = ("node struct<" + ", ".join(f"{c}: long" for c in NODE[:-1]) + ", ends_sha256: string, end_key: binary, parent_key: binary, own_key: binary>, "
              "open struct<path: binary, lens: array<int>, " + ", ".join(f"`{c}`: array<long>" for c in SUMS) + ">")
NONE = np.iinfo(np.int64).max
NO_ENDS = hashlib.sha256(b"").hexdigest()


def head_size(conv: Column) -> Column:
    """How many first turns a conversation takes from the one that its hundred begins with."""
    return (F.crc32(conv.cast("string")) % (MAX_HEAD + 1)).cast("int")


def rebuilt_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                          text_col: str = "text") -> DataFrame:
    """``(conv, path, lens)``: every conversation's rebuilt turns, as digests one after another and as code points of the texts."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).substr(1, DIGITS)
    flat = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.struct(F.col(turn_col).alias("turn"), digest.alias("digest"), F.length(text).alias("len")).alias("t"))
    own = stored(flat.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("t"))
                 .select("conv", F.col("t.digest").alias("digests"), F.col("t.len").alias("lens")), "conversations")
    hundred = F.col("conv") - F.col("conv") % 100
    heads = own.where(F.col("conv") % 100 == 0).select(F.col("conv").alias("hundred"), F.slice("digests", 1, MAX_HEAD).alias("head"),
                                                       F.slice("lens", 1, MAX_HEAD).alias("head_lens"))
    h = head_size(F.col("conv"))

    def mixed(head: str, rest: str, none: str) -> Column:
        borrowed = F.coalesce(F.slice(head, F.lit(1), h), F.array().cast(none))
        return F.concat(borrowed, F.slice(rest, h + 1, F.greatest(F.size(rest), F.lit(1))))
    return (own.withColumn("hundred", hundred).join(heads, "hundred", "left")
            .select("conv", F.unhex(F.array_join(mixed("head", "digests", "array<string>"), "")).alias("path"),
                    mixed("head_lens", "lens", "array<int>").alias("lens")))


def _node_key(path: Column) -> Column:
    return F.unhex(F.sha2(path, 256).substr(1, DIGITS))


def peel(paths: list[bytes], lens: list[np.ndarray], sums: list[tuple[np.ndarray, ...]], whole: bool,
         again: bool = False) -> tuple[list[dict], list[dict]]:
    """The finished nodes and the open paths of distinct paths in ascending order, each with its nodes' sums.

    A path's sums are those of its last nodes, or of all.  ``whole``: no node
    goes on in another task, so all are finished.  ``again``: nodes come with their keys, as
    others may have been finished before them.
    """
    count = len(paths)
    turns = [np.frombuffer(p, dtype="<u8").reshape(-1, WIDTH // 8) for p in paths]
    length = np.array([len(t) for t in turns])
    common = np.full(count, -1)  # turns shared with the path before; the first path does not even share the root
    for i in range(1, count):
        m = min(length[i], length[i - 1])
        apart = (turns[i][:m] != turns[i - 1][:m]).any(axis=1)
        common[i] = int(apart.argmax()) if apart.any() else m
    born = length - common  # nodes that a path is the first to pass
    first = np.concatenate([[0], np.cumsum(born)])
    size = int(first[-1])
    owner = np.repeat(np.arange(count), born)
    depth = np.arange(size) - np.repeat(first[:-1] - common, born) + 1
    parent = np.arange(size) - 1
    last_len = np.zeros(size, dtype=np.int64)
    acc = {c: np.full(size, NONE if c in SMALLEST else 0, dtype=np.int64) for c in SUMS}
    way = np.zeros(int(length.max()) + 1, dtype=np.int64)  # the nodes of the path at hand by depth
    for i in range(count):
        k, top = int(common[i]), int(length[i])
        if i:
            parent[first[i]] = way[k]
        way[k + 1:top + 1] = np.arange(first[i], first[i + 1])
        last_len[first[i]:first[i + 1]] = lens[i][k:] if i else np.concatenate([[0], lens[i]])
        on = way[top + 1 - len(sums[i][0]):top + 1]
        for c, given in zip(SUMS, sums[i]):
            acc[c][on] = np.minimum(acc[c][on], given) if c in SMALLEST else acc[c][on] + given
        if not i:
            first_way = way[:top + 1].copy()
    last_way = way[:int(length[-1]) + 1]
    is_open = np.zeros(size, dtype=bool)
    if not whole:
        is_open[first_way] = is_open[last_way] = True

    by_depth = np.argsort(depth, kind="stable")
    starts = np.searchsorted(depth[by_depth], np.arange(int(depth.max()) + 2))
    for d in range(int(depth.max()), -1, -1):
        here = by_depth[starts[d]:starts[d + 1]]
        here = here[~is_open[here]]
        acc["leaves"][here] = np.where(acc["children"][here] == 0, 1, acc["leaves"][here])
        acc["saved"][here] += (acc["n"][here] - 1) * last_len[here]
        if d:  # strip the last turn
            up = parent[here]
            for c in ("n", "leaves", "saved"):
                np.add.at(acc[c], up, acc[c][here])
            np.add.at(acc["children"], up, 1)
            np.minimum.at(acc["least"], up, acc["least"][here])

    nodes = []
    for v in np.flatnonzero(~is_open).tolist():
        p, d, path = int(parent[v]), int(depth[v]), paths[owner[v]]
        waits = d > 1 and is_open[p]
        ends = int(acc["ends"][v])
        sha = NO_ENDS if not ends else hashlib.sha256(str(int(acc["first_end"][v])).encode()).hexdigest() if ends == 1 else None
        own = _key(path[:WIDTH * d]) if again or ends > 1 else None
        nodes.append({"conv_id": int(acc["least"][v]), "depth": d, "parent_conv_id": None if not d or is_open[p] else int(acc["least"][p]),
                      "n_convs": int(acc["n"][v]), "n_children": int(acc["children"][v]), "n_leaves": int(acc["leaves"][v]),
                      "saved_tokens": int(acc["saved"][v]), "ends_sha256": sha, "end_key": own if ends > 1 else None,
                      "parent_key": _key(path[:WIDTH * (d - 1)]) if waits else None, "own_key": own if again else None})
    opened = []
    for i, on in [] if whole else [(0, first_way), (count - 1, last_way)][:count]:
        opened.append({"path": paths[i], "lens": np.asarray(lens[i], dtype=np.int32), **{c: acc[c][on] for c in SUMS}})
        for c in SUMS:  # what both paths share goes with the first
            acc[c][on] = NONE if c in SMALLEST else 0
    return nodes, opened


def _key(path: bytes) -> bytes:
    return hashlib.sha256(path).digest()[:WIDTH]


def _peeled(paths: DataFrame, tasks: int, again: bool) -> DataFrame:
    """One round: ``(node, open)`` records of the paths, dealt in order to so many tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lens, sums = [], [], []
        for batch in batches:
            keys += batch.column("path").to_pylist()
            lens += [np.asarray(v, dtype=np.int64) for v in batch.column("lens").to_pylist()]
            columns = [batch.column(c).to_pylist() for c in SUMS]
            sums += [tuple(np.asarray(v, dtype=np.int64) for v in row) for row in zip(*columns)]
        if not keys:
            return
        nodes, opened = peel(keys, lens, sums, tasks == 1, again)
        for at in range(0, len(nodes), 10_000):
            part = pa.array(nodes[at:at + 10_000], type=RECORD.field("node").type)
            yield pa.RecordBatch.from_arrays([part, pa.nulls(len(part), RECORD.field("open").type)], schema=RECORD)
        for one in opened:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, RECORD.field("node").type), pa.array([one], type=RECORD.field("open").type)], schema=RECORD)
        give_back()

    dealt = paths.coalesce(1) if tasks == 1 else paths.repartitionByRange(tasks, "path")
    return dealt.sortWithinPartitions("path").mapInArrow(run, RECORD_DDL)


def ends_hashes(ends: DataFrame) -> DataFrame:
    """``(end_key, ends_sha256)`` of ``(end_key, conv)`` rows: the hash of the decimal ids of a key, ascending, joined by commas.

    Tasks of even size write the ids out in pieces, so that the one that
    hashes a key's pieces in turn reads few rows, whatever the key's share.
    """
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, start, text, size, out = None, None, [], 0, []

        def flush() -> None:
            nonlocal text, size
            if text:
                out.append((key, start, ",".join(text)))
            text, size = [], 0
        for batch in batches:
            for k, conv in zip(batch.column("end_key").to_pylist(), batch.column("conv").to_pylist()):
                if k != key or size > PIECE_BYTES:
                    flush()
                    key, start = k, conv
                text.append(str(conv))
                size += len(text[-1]) + 1
            if len(out) > 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, o)) for o in out], schema=kind)
                out.clear()
        flush()
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, o)) for o in out], schema=kind)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for k, piece in zip(batch.column("end_key").to_pylist(), batch.column("piece").to_pylist()):
                if k != key:
                    if key is not None:
                        done.append({"end_key": key, "ends_sha256": state.hexdigest()})
                    key, state = k, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(piece.encode())
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=result)
        if key is not None:
            yield pa.RecordBatch.from_pylist([{"end_key": key, "ends_sha256": state.hexdigest()}], schema=result)

    names = ("end_key", "start", "piece")
    kind = pa.schema([("end_key", pa.binary()), ("start", pa.int64()), ("piece", pa.string())])
    result = pa.schema([("end_key", pa.binary()), ("ends_sha256", pa.string())])
    tasks = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    written = (ends.repartitionByRange(tasks, "end_key", "conv").sortWithinPartitions("end_key", "conv")
               .mapInArrow(pieces, "end_key binary, start long, piece string"))
    return written.repartition("end_key").sortWithinPartitions("end_key", "start").mapInArrow(hashed, "end_key binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                task_turns: int = TASK_TURNS) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations, the root included.

    Columns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.  Turns are ordered by their number, null first,
    those of equal number by the digest of role and text; repeated rows are
    turns like others.  A null role or text is empty.  Rows without conv_id
    belong to no conversation.  A conversation left without turns ends at the
    root.  Texts are hashed whole and not carried along; a conversation is one
    record of 20 bytes a turn, which bounds it to about a hundred million
    turns.  An empty table has no nodes.  Other columns are not read.
    """
    convs = stored(rebuilt_conversations(turns, conv_col, turn_col, role_col, text_col), "rebuilt")
    distinct = convs.groupBy("path", "lens").agg(F.count("*").alias("ends"), F.min("conv").alias("least"))
    given = {"n": "ends", "least": "least", "ends": "ends", "first_end": "least"}
    todo = stored(distinct.select("path", "lens", *[F.array(F.col(given[c]) if c in given else F.lit(0).cast("long")).alias(c) for c in SUMS]), "paths")
    finished, tasks = [], 0
    while tasks != 1:
        load = todo.agg(F.count("*").alias("rows"), F.sum(F.size("lens") + 1).alias("turns")).first()
        tasks = max(1, min(-(-(load["turns"] or 0) // task_turns), load["rows"] // 8))  # 8 or more paths leave 2
        done = stored(_peeled(todo, tasks, again=bool(finished)), "peeled")
        finished.append(done.where("node is not null").select("node.*"))
        todo = done.where("open is not null").select("open.*")
    nodes = finished[0]
    for more in finished[1:]:
        nodes = nodes.unionByName(more)
    if len(finished) > 1:
        nodes = _with_parents(nodes, convs.agg(F.min("conv").alias("conv")).first()["conv"])
    hashes = ends_hashes(convs.select(_node_key(F.col("path")).alias("end_key"), "conv"))
    several = nodes.where("end_key is not null").drop("ends_sha256").join(hashes, "end_key")
    return nodes.where("end_key is null").select(*NODE).unionByName(several.select(*NODE))


def _with_parents(nodes: DataFrame, least: int) -> DataFrame:
    """The nodes with their parent's number also where they were finished before it; ``least`` is the root's."""
    parents = nodes.where("own_key is not null").select(F.col("own_key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    waiting = nodes.where("parent_key is not null")
    if parents.limit(BROADCAST_ROW_LIMIT + 1).count() <= BROADCAST_ROW_LIMIT:  # nodes on the borders of tasks
        found = waiting.join(F.broadcast(parents), "parent_key")
    else:  # a parent may have most of all nodes as children
        parents = parents.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(PARENT_SALTS - 1))))
        found = waiting.withColumn("_salt", F.pmod(F.xxhash64("conv_id"), F.lit(PARENT_SALTS)).cast("int")).join(parents, ["parent_key", "_salt"])
    found = found.withColumn("parent_conv_id", F.col("_parent")).select(nodes.columns)
    top = F.when(F.col("depth") == 1, F.lit(least)).otherwise(F.col("parent_conv_id"))
    return nodes.where("parent_key is null").withColumn("parent_conv_id", top).unionByName(found)


ORACLE_OP12 = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                                     sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
           FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT DISTINCT conv_id, xor(4294967295, list_reduce(
               list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
               lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(8)),
                                          lambda x, step: xor(x >> 1, 3988292384 * (x & 1))))) % 6 AS h
      FROM t),
mixed AS (SELECT h.conv_id, k, role, text FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 100 AND k <= h
          UNION ALL SELECT h.conv_id, k, role, text FROM h JOIN t ON t.conv_id = h.conv_id AND k > h),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS depth, length(text) AS len,
                 sha256(strlen(role)::VARCHAR || ':' || role || text) AS turn FROM mixed),
pre AS (SELECT conv_id, depth, len, md5(string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS key FROM turns
        UNION ALL SELECT conv_id, 0, 0, 'root' FROM h),
way AS (SELECT *, lag(key) OVER w AS up, depth = max(depth) OVER (PARTITION BY conv_id) AS ended FROM pre WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
node AS (SELECT key, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(len) AS saved, min(up) AS up,
                coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '') AS ends FROM way GROUP BY key),
kids AS (SELECT up AS key, count(*) AS n_children FROM node WHERE up IS NOT NULL GROUP BY up),
below AS (SELECT way.key, count(*) FILTER (kids.key IS NULL) AS n_leaves, sum(node.saved) AS saved_tokens
          FROM node LEFT JOIN kids USING (key) JOIN way ON way.conv_id = node.conv_id AND way.depth <= node.depth GROUP BY way.key)
SELECT node.conv_id, node.depth, parent.conv_id AS parent_conv_id, node.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       saved_tokens::BIGINT AS saved_tokens, sha256(node.ends) AS ends_sha256
FROM node JOIN below USING (key) LEFT JOIN kids USING (key) LEFT JOIN node AS parent ON parent.key = node.up
"""
