"""Embedding whitening, conversation trie and exact dedup against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sextant.llm import exact_dedup as dedup
from sextant.llm.exact_dedup import build_perfect_hash, look_up
from sextant.llm.prefix_trie import ends_hashes, peel, prefix_trie
from sextant.llm.whitening import components, qdwh_polar, whiten

from .conftest import collected

# ---------------------------------------------------------------- whitening


@pytest.mark.parametrize("kind", ["any", "repeated", "low rank", "equal", "zero", "steep", "diagonal"])
def test_components_are_those_of_the_matrix(kind):
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.standard_normal((24, 24)))[0]
    values = {"any": rng.random(24), "repeated": np.r_[np.full(6, 5.0), np.full(18, 1.0)], "low rank": np.r_[rng.random(3), np.zeros(21)],
              "equal": np.full(24, 2.0), "zero": np.zeros(24), "steep": 10.0 ** -np.arange(24), "diagonal": np.arange(24.0)}[kind]
    a = np.diag(values) if kind == "diagonal" else q @ np.diag(values) @ q.T
    w, v = components(a, 6)
    assert np.allclose(w, np.sort(values)[::-1][:6], atol=1e-13)
    assert np.allclose(v.T @ v, np.eye(6), atol=1e-13) and np.allclose(a @ v, v * w, atol=1e-12)


def test_polar_factor():
    a = np.random.default_rng(1).standard_normal((9, 9))
    u, _, vt = np.linalg.svd(a)
    assert np.allclose(qdwh_polar(a), u @ vt, atol=1e-13)
    assert np.array_equal(qdwh_polar(np.zeros((2, 2))), np.eye(2))


def vectors(spark, rows, parts=3):
    """Rows of (id, vector) with columns whose names clash with results."""
    return spark.createDataFrame([(i, v, 1.0, "n") for i, v in rows], "vec_id long, embedding array<float>, whitened double, component string").repartition(parts)


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((200, 6)) @ rng.standard_normal((6, 6))).astype(np.float32)
    x[50:120] = x[50]  # a third of all rows
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (903, [float("nan")] * 6), (904, [float("inf")] + [0.0] * 5), (905, [1.0, 2.0])]
    got = defaultdict(dict)
    for r in whiten(vectors(spark, rows + bad + [(None, x[0].tolist()), (3, x[3].tolist())])).collect():
        got[r["vec_id"]][r["component"]] = r
    whole = np.floor(256 * x.astype(float)).astype(np.int64)
    fit = np.unique(whole, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    v = (fit - s / n).T @ (fit - s / n) / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:4], u[:, ::-1][:, :4]
    want = (whole - s / n) @ u / np.sqrt(e)
    assert set(got) == {*range(200), None} and all(set(c) == {1, 2, 3, 4} for c in got.values())
    for k in range(4):
        have = np.array([got[i][k + 1]["whitened"] for i in range(200)])
        assert np.allclose(have * np.sign(have[7] * want[7, k]), want[:, k], atol=1e-9)
        assert math.isclose(got[0][k + 1]["explained"], e[k] / np.trace(v), rel_tol=1e-12)
    assert all(got[i][1]["deviation"] == int(((n * whole[i] - s) ** 2).sum()) and got[i][1]["n"] == n for i in range(200))
    assert got[None][2]["whitened"] == got[0][2]["whitened"] and got[0][1]["identity_error"] < 1e-10


@pytest.mark.parametrize("rows, count", [([], 0), ([(1, None)], 0), ([(1, [2.0, 3.0]), (2, [2.0, 3.0])], 4), ([(1, [1.0]), (2, [5.0])], 2)])
def test_whitening_without_variance(spark, rows, count):
    got = whiten(vectors(spark, rows, 1)).collect()
    assert len(got) == count
    if count == 4:
        assert {(r["whitened"], r["explained"], r["identity_error"], r["deviation"], r["n"]) for r in got} == {(0.0, 0.0, 0.0, 0, 1)}
    if count == 2:
        assert sorted(round(r["whitened"], 9) for r in got) == [-1.0, 1.0] and {r["explained"] for r in got} == {1.0}


def test_deviation_beyond_64_bits_is_null_and_large_ones_are_exact(spark):
    got = {r["vec_id"]: r["deviation"] for r in whiten(vectors(spark, [(1, [1e16]), (2, [-1e16]), (3, [3.0])], 1)).collect()}
    assert got[1] is None and got[2] is None
    x = [int(np.floor(256 * float(np.float32(c)))) for c in (1e16, -1e16, 3.0)]
    assert got[3] == (3 * x[2] - sum(x)) ** 2


# ---------------------------------------------------------------- trie


def brute_trie(rows):
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:])
    members, children, below = defaultdict(list), defaultdict(set), {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                children[path[:d - 1]].add(path[:d])
    for path in sorted(members, key=len, reverse=True):
        kids = [below[k] for k in children[path]]
        saved = (len(members[path]) - 1) * len(path[-1][1]) if path else 0
        below[path] = (sum(k[0] for k in kids) or 1, saved + sum(k[1] for k in kids))
    return {(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), *below[p],
             hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(p)))).encode()).hexdigest()) for p, m in members.items()}


def turns_of(spark, rows, parts=5):
    return spark.createDataFrame([(*r, 7, b"x") for r in rows], "conv_id long, turn long, role string, text string, depth int, path binary").repartition(parts)


def some_turns(seed, convs, words=3):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        for t in range(rng.choice([1, 2, 3, 6, 9])):
            rows.append((c, t, rng.choice(["user", "assistant"]), f"w{rng.randrange(words)}é"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("task_turns", [100, 100_000])
def test_trie_equals_brute_force(spark, task_turns):
    rows = some_turns(1, [*range(150), *range(990, 1020), -5, -130, -100])
    rows += [(c, t, "user", "the same") for c in range(300, 390) for t in range(7)]  # a third of all rows
    rows += [(500, t, "user", f"long {t % 3}") for t in range(150)] + [(501, t, "user", f"long {t % 3}") for t in range(149)]
    rows += [(None, 1, "user", "none"), (7, None, None, None), (7, None, None, None), (8, 0, "user", None), (600, 5, "user", "short")]
    got = prefix_trie(turns_of(spark, rows), task_turns=task_turns).collect()
    want = brute_trie(rows)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_trie_parents_by_salt(spark, monkeypatch):
    monkeypatch.setattr("sextant.llm.prefix_trie.BROADCAST_ROW_LIMIT", 1)
    rows = some_turns(4, range(120), words=1)
    got = prefix_trie(turns_of(spark, rows), task_turns=60).collect()
    assert {tuple(r) for r in got} == brute_trie(rows) and len(got) == len({tuple(r) for r in got})


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert prefix_trie(turns_of(spark, [(None, 1, "user", "x")], 1)).collect() == []
    rows = [(c, 0, "user", "x") for c in range(201, 212)]  # nothing to borrow: those that lose their turn end at the root
    assert {tuple(r) for r in prefix_trie(turns_of(spark, rows)).collect()} == brute_trie(rows)


def test_open_paths_carry_what_was_gathered():
    def path(*turns):
        return b"".join(bytes([t]) * 16 for t in turns)
    paths = [path(1), path(1, 2), path(1, 2, 3), path(1, 4)]
    one = [tuple(np.array([x]) for x in (1, c, 0, 0, 0, 1, c)) for c in range(4)]
    lens = [np.array([5] * (len(p) // 16)) for p in paths]
    nodes, opened = peel(paths[:3], lens[:3], one[:3], whole=False)
    assert [n["depth"] for n in nodes] == [2] or not nodes  # only what is on neither border is finished
    left = [(o["path"], o["lens"], tuple(o[c] for c in ("n", "least", "children", "leaves", "saved", "ends", "first_end"))) for o in opened]
    again, _ = peel([p for p, _, _ in left] + paths[3:], [x for _, x, _ in left] + lens[3:], [s for _, _, s in left] + one[3:], whole=True, again=True)
    whole, _ = peel(paths, lens, one, whole=True)
    strip = [{k: v for k, v in n.items() if k not in ("own_key", "parent_key")} for n in nodes + again]
    assert sorted(map(str, strip)) == sorted(str({k: v for k, v in n.items() if k not in ("own_key", "parent_key")}) for n in whole)


def test_ends_are_hashed_in_numeric_order(spark, monkeypatch):
    monkeypatch.setattr("sextant.llm.prefix_trie.PIECE_BYTES", 20)
    ids = {b"a": list(range(-3, 120)), b"b": [5], b"c": [10, 9]}
    rows = [(bytearray(k), c) for k, cs in ids.items() for c in cs]
    random.Random(1).shuffle(rows)
    got = {bytes(r[0]): r[1] for r in ends_hashes(spark.createDataFrame(rows, "end_key binary, conv long")).collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, sorted(c))).encode()).hexdigest() for k, c in ids.items()}


# ---------------------------------------------------------------- exact dedup


def brute_dedup(rows):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i if i is not None else 0, k))
    out = {}
    for norm, group in groups.items():
        best = min(group)
        keep = None if best[1] else best[2]
        for g in group:
            out[g[3]] = (None if g[1] else g[2], keep, len(group), hashlib.sha256(norm.encode()).hexdigest())
    return [out[k] for k in range(len(rows))]


def dedup_rows():
    rows = [(k, f"text {k % 180}" + " " * (k % 5)) for k in range(600)] + [(k, "copy of a third\t") for k in range(600, 950)]
    rows += [(1000, None), (1001, ""), (1002, " \t\r\n\x0b\x0c"), (None, "text 7"), (None, None), (None, "alone"), (1003, "a b"), (1004, "ab"),
             (1005, "long " * 50_000), (1006, "long" * 50_000), (3, "text 3   "), (3, "text 3   ")]
    return rows


@pytest.mark.parametrize("share, shard", [(0.5, 65_536), (0.0, 8), (1.0, 16)])
def test_dedup_equals_brute_force(docs_of, monkeypatch, share, shard):
    monkeypatch.setattr(dedup, "SHARD_SLOTS", shard)
    rows = dedup_rows()
    found = dedup.exact_dedup(docs_of(rows), history_share=share)
    assert collected(found, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(
        brute_dedup(rows), key=lambda r: tuple((x is not None, x) for x in r))
    kept = [r for r in found.collect() if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in kept}) == len({w[3] for w in brute_dedup(rows)})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_dedup_of_nothing(docs_of):
    assert dedup.exact_dedup(docs_of([], 1)).count() == 0
    assert [tuple(r)[:4] for r in dedup.exact_dedup(docs_of([(None, None)], 1)).collect()] == [(None, None, 1, True)]


def test_perfect_hash_is_minimal_and_turns_others_away(spark, monkeypatch):
    monkeypatch.setattr(dedup, "SEED_STEPS", (0, 4, 8))  # few seeds, so that several levels are needed
    monkeypatch.setattr(dedup, "SHARD_SLOTS", 100)
    keys = [hashlib.sha256(str(k).encode()).digest() for k in range(1500)]
    index = build_perfect_hash(spark.createDataFrame([(bytearray(k), n) for n, k in enumerate(keys)], "digest binary, winner int"))
    slots = {r["slot"]: (bytes(r["digest"]), r["winner"]) for r in index.slots.collect()}
    assert sorted(slots) == list(range(1500)) and len(index.level_buckets) > 2
    assert {v[0]: v[1] for v in slots.values()} == {k: n for n, k in enumerate(keys)}
    others = [hashlib.sha256(f"other {k}".encode()).digest() for k in range(500)]
    looked = look_up(index, spark.createDataFrame([(bytearray(k),) for k in keys + others], "digest binary")).collect()
    assert len(looked) == 2000
    for r in looked:
        member = bytes(r["digest"]) in set(keys) if r["slot"] is None else slots[r["slot"]][0] == bytes(r["digest"])
        assert member == (bytes(r["digest"]) in set(keys))
