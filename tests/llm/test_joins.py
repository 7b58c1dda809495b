"""Sharding, nearest neighbours, decontamination and the pipeline against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sextant.llm import neighbours, sharding
from sextant.llm.decontamination import benchmark_windows, contamination, keyed, near_hits
from sextant.llm.sharding import bounded_ring_shards, bounded_walk

from .conftest import collected


def test_shards_are_level_and_slots_gapless(docs_of, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 16)
    rows = [(k, f"text {k % 700}" if k % 3 else "the same") for k in range(1000)] + [(None, None), (5, "text 5"), (2000, ""), (2001, "é")]
    found = bounded_ring_shards(docs_of(rows), n_shards=7).collect()
    counts = Counter(r["shard"] for r in found)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(counts[s]))
    given = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == given
    assert {r["law"] for r in found} == {"rows"} and {r["grown_shard"] for r in found} == {None}


def test_one_more_shard_moves_few_rows(docs_of):
    docs = docs_of([(k, f"text {k}") for k in range(2000)])
    a, b = ({r["doc_id"]: r["shard"] for r in bounded_ring_shards(docs, n).collect()} for n in (8, 9))
    assert np.mean([a[i] != b[i] for i in a]) < 0.45  # a hash of id and count would move 8 of 9


def test_few_rows_and_no_rows(docs_of):
    assert bounded_ring_shards(docs_of([], 1)).count() == 0
    assert sorted(r["slot"] for r in bounded_ring_shards(docs_of([(1, "a"), (2, None)])).collect()) == [0, 0]


def test_bounded_walk_continues_clockwise():
    arcs = [(10, 0), (20, 1), (30, 2)]
    assert bounded_walk(arcs, {0: 6}, 3) == [(0, 0, 2, 0, 0), (0, 2, 4, 1, 0), (0, 4, 6, 2, 0)]


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_neighbours_recall_and_order(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 150)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 20)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    x = unit(centres[rng.integers(0, 12, 1500)] + 0.4 * rng.standard_normal((1500, 16)))
    x[200:240] = x[200]  # copies tie
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    bad = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0, None] * 8), (2080, [float("inf")] * 16), (2100, [1.0] * 3), (None, [1.0] * 16)]
    table = spark.createDataFrame([*rows, *bad, rows[40]], "vec_id long, embedding array<double>").repartition(4)
    found = neighbours.learned_partition_search(table, every=20, k=10, sample_rows=600).collect()
    by_query = {}
    for r in found:
        by_query.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by_query) == set(range(0, 1500, 20))
    recall = []
    for q, got in by_query.items():
        got.sort()
        assert [r for r, _, _ in got] == list(range(1, 11)) and len({v for _, v, _ in got}) == 10
        assert [(-s, v) for _, v, s in got] == sorted((-s, v) for _, v, s in got)
        assert all(math.isclose(s, float(x[q] @ x[v]), abs_tol=1e-12) and v != q for _, v, s in got)
        exact = (x * x[q]).sum(axis=1)
        exact[q] = -9
        recall.append(len(set(np.lexsort((np.arange(1500), -exact))[:10]) & {v for _, v, _ in got}) / 10)
    assert np.mean(recall) >= 0.9


def test_neighbours_of_few_and_no_rows(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 1.0]), (3, [0.0, -1.0])], "vec_id long, embedding array<double>")
    found = neighbours.learned_partition_search(table).collect()
    assert {(r["query_id"], r["vec_id"], r["rank"]) for r in found} == {(0, 20, 1), (0, 3, 2), (20, 0, 1), (20, 3, 2)}
    assert neighbours.learned_partition_search(table.limit(0)).count() == 0
    assert neighbours.learned_partition_search(table.where("vec_id = 0")).count() == 0


def test_balanced_parts_are_balanced_and_cut_few_edges():
    rng = np.random.default_rng(1)
    x = unit(np.repeat(rng.standard_normal((8, 12)), 64, axis=0) + 0.2 * rng.standard_normal((512, 12)))
    graph = neighbours.neighbour_graph(x, 8)
    label = neighbours.balanced_parts(graph, 8, rng)
    assert np.bincount(label, minlength=8).max() <= math.ceil(1.05 * 64) and (label[graph] == label[:, None]).mean() > 0.6


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))


def brute_contamination(rows, items, n):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(str(item))
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[tuple(w[i:i + size])]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("n", [10, 3, 1])
def test_contamination(spark, docs_of, n):
    rng = random.Random(n)
    vocabulary = ["the", "of", "É", "é", "a1", "B2", "straße", "漢字", "x"] + [f"w{k}" for k in range(30)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 9, 10, 11, 40])))) for k in range(25)]
    items += [(98, None), (99, "?!"), (100, items[3][1]), (101, "of the of the of the of the of the of the")]
    rows = []
    for k in range(60):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5:
            w = rng.choice(items)[1] or ""
            text[rng.randrange(len(text) + 1):0] = w.upper().split()[rng.randrange(3):]
        rows.append((k, rng.choice([" ", "-", "\n", "_, "]).join(text)))
    rows += [(70, None), (71, ""), (72, "of the " * 2000), (None, rows[1][1]), (1, rows[1][1]), (73, items[0][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = contamination(docs_of(rows), benchmark, n=n)
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert collected(found, *columns) == brute_contamination(rows, items, n)
    assert contamination(docs_of([], 1), benchmark).count() == 0
    assert not any(r["contaminated"] for r in contamination(docs_of(rows[:5]), benchmark.limit(0)).collect())


def test_proximity(spark, docs_of):
    docs = keyed(docs_of([(1, "rare1 filler filler rare2"), (2, "rare1 rare2"), (3, "rare1 a b c d e f rare2"), (4, "rare2 rare1"), (5, "filler")]), "doc_id", "text")
    phrases = benchmark_windows(spark.createDataFrame([(1, "rare1 rare2")], "item_id long, text string"), 10, "item_id", "text")
    hits = near_hits(docs, phrases.select("phrase"), slop=2, n=10)
    assert collected(hits.join(docs, ["k1", "k2"]), "id") == [(1,), (2,), (4,)]


@pytest.mark.parametrize("slop", [0, 2])
def test_proximity_over_all_terms(spark, docs_of, slop):
    rng = random.Random(slop)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 4, 10, 14])))) for k in range(12)] + [(50, None)]
    rows = []
    for k in range(80):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(0, 25))]
        loose = (rng.choice(items)[1] or "").split()
        for _ in range(rng.choice([0, 0, 1, 2])):  # words put between, left out or changed
            at = rng.randrange(len(loose) + 1)
            loose[at:at + rng.choice([0, 0, 1])] = [rng.choice(vocabulary)] * rng.choice([0, 1])
        rows.append((k, " ".join(text + loose + text[:4])))
    rows += [(90, None), (None, items[3][1])]
    split = [words(t) for _, t in rows]
    counts = Counter(w for ws in split for w in ws)
    windows = {(i, tuple(ws[a:a + 10])) for i, t in items if (ws := words(t)) for a in range(max(1, len(ws) - 9))}
    want = []
    for (doc, _), ws in zip(rows, split):
        near = set()
        for item, win in windows:
            o1 = min(range(len(win)), key=lambda o: (counts[win[o]], o))
            near |= {item for p in range(len(ws)) if ws[p] == win[o1] and all(
                term in ws[max(0, p - o1 + o - slop):max(0, p - o1 + o + slop + 1)] for o, term in enumerate(win))}
        want.append((doc, len(near)))
    found = contamination(docs_of(rows), spark.createDataFrame(items, "item_id long, text string"), slop=slop)
    assert collected(found, "doc_id", "n_near_items") == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))
    if not slop:
        assert found.where("n_near_items <> n_items").isEmpty()


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from .test_text_models import GOOD, labelled

    docs, labels = labelled(300)
    rng = random.Random(9)
    passage = " ".join(rng.choice(GOOD) for _ in range(50))
    fresh = [" ".join(rng.choice(GOOD) for _ in range(120)) for _ in range(8)]
    item = " ".join(fresh[3].split()[20:40])
    extra = [(1000, fresh[0]), (1001, fresh[0]), (1002, fresh[0].replace(" ", "  ")), (1003, fresh[1] + " " + passage), (1004, passage + "\n" + fresh[2]),
             (1005, fresh[3]), (1006, fresh[4]), (1007, None), (1008, ""), (None, fresh[5])]
    rows = [(i, t, "en", "s", len(t or ""), "extra") for i, t in [*docs, *extra]]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    table = spark.read.parquet(f"{d}/documents.parquet")
    columns = table.columns
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_classifier"](spark, table, d)
    assert good.columns == columns
    assert {r["doc_id"] for r in good.collect()} >= {1003, 1004, 1005, 1006} and not {r["doc_id"] for r in good.collect()} & {i for i, q in labels if not q}
    kept = stages["ngram_jaccard_join"](spark, table.where("doc_id >= 1000 or doc_id is null"), d)
    assert sorted((r["doc_id"] for r in kept.collect()), key=lambda x: x or 0) == [None, 1000, 1003, 1004, 1005, 1006, 1007, 1008] and kept.columns == columns
    cut = {r["doc_id"]: r for r in stages["substring_dedup"](spark, kept, d).collect()}
    assert cut[1003]["text"] == fresh[1] and cut[1003]["n_chars"] == len(fresh[1]) and cut[1004]["text"] == fresh[2] and cut[1006]["text"] == fresh[4]
    clean = stages["benchmark_decontamination"](spark, kept, d)
    assert 1005 not in {r["doc_id"] for r in clean.collect()} and clean.count() == kept.count() - 1 and clean.columns == columns
    packed = corpus_pipeline.run(spark, d).collect()
    ids = {r["doc_id"] for r in packed}
    assert 1006 in ids and not ids & {1001, 1002, 1005}
    for s in {r["sequence_id"] for r in packed}:
        assert sum(r["length"] for r in packed if r["sequence_id"] == s) <= 1024


def test_pipeline_keeps_one_document_of_each_group(spark):
    import corpus_pipeline

    rng = random.Random(4)
    words = [f"w{k}" for k in range(500)]
    a, b, c, d, e = (" ".join(rng.choice(words) for _ in range(60)) for _ in range(5))
    rows = [(1, a), (None, a), (None, a), (None, a + " x"),  # copies without an id beside one with an id
            (None, b), (None, b), (None, b + " x"),  # a group without any id
            (2, c), (2, c + " x"), (2, c), (3, c + " y"),  # near copies that share an id
            (4, d), (4, e), (5, e + " x"),  # texts that share an id and nothing else
            (6, "."), (None, ""), (None, None), (None, " ")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [tuple(r) for r in dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, table, "").collect()]
    group = [(doc, (text or " ").replace(" x", "").replace(" y", "")) for doc, text in kept]
    assert sorted(g for g in group if g[0]) == sorted([(1, a), (2, c), (4, d), (4, e), (6, ".")])
    assert [t for doc, t in group if doc is None and t.strip()] == [b] and len(kept) == 9


CLASHING = "id, th, gone_id, gone_text, text_hash, k0, k1, g0, g1, row, c0, chunk, predicted, contaminated, group, n_words, rest".split(", ")


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages_pass_columns_of_any_name(spark, tmp_path, empty):
    import corpus_pipeline
    from .test_text_models import labelled

    docs, labels = labelled(120)
    d = str(tmp_path)
    schema = "doc_id long, text string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    rows = [(i, t, len(t), *CLASHING) for i, t in docs] + [(None, None, None, *CLASHING)]
    table = spark.createDataFrame([] if empty else rows, schema)
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "no such words")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, d)
        found = out.collect()
        assert out.columns == table.columns and (len(found) == 0) == empty
        assert all(tuple(r)[3:] == tuple(CLASHING) for r in found)
    if empty:
        assert corpus_pipeline.STAGES[-1][1](spark, table, d).count() == 0


def test_neighbours_of_clashing_ids_and_queries_with_few_candidates_in_their_parts(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = unit(np.repeat(rng.standard_normal((40, 8)), 5, axis=0) + 0.02 * rng.standard_normal((200, 8)))
    rows = [(i, v.tolist(), "x", 1) for i, v in enumerate(x)] + [(7, (-x[7]).tolist(), "y", 2), (20, (-x[20]).tolist(), "y", 2)]
    monkeypatch.setattr(neighbours, "PART_SAMPLE", 8)
    monkeypatch.setattr(neighbours, "fit", lambda x, parts, k, recall, whole=neighbours.fit: neighbours.Router(
        *(lambda r: (r.w1, r.b1, r.w2, r.b2))(whole(x, parts, k, recall)), 1))  # one part is tried, which holds too few
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string, rank int").repartition(3)
    found = neighbours.learned_partition_search(table, every=20, k=150).collect()
    for i in (7, 20):
        x[i] = min(x[i].tolist(), (-x[i]).tolist())  # of two vectors with one id the lesser counts
    for q in range(0, 200, 20):
        exact = (x * x[q]).sum(axis=1)
        exact[q] = -9
        got = [r["vec_id"] for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])]
        assert got == np.lexsort((np.arange(200), -exact))[:150].tolist()


def test_parts_grow_with_the_table():
    assert [neighbours.part_count(n, min(n, 16_384)) for n in (1, 500, 10_000, 1_000_000, 10 ** 9)] == [1, 4, 64, 256, 256]


def test_sets_leave_the_worker_in_bounded_batches():
    import numpy as np

    from sextant.llm.jaccard import _by_size

    sizes = np.array([3, 3, 3, 20, 1, 9, 1])
    assert list(_by_size(sizes, 10)) == [(0, 3), (3, 4), (4, 6), (6, 7)]
    assert list(_by_size(sizes[:0], 10)) == []


def test_sets_with_a_few_phrases_in_common_share_hardly_any_part():
    from sextant.llm.jaccard import Radius, part_keys

    radius, rng = Radius(80, 100), np.random.default_rng(2)
    def a_set(n, *more):
        return np.unique(np.concatenate([rng.integers(0, 1 << 63, n, dtype=np.uint64), *more]))
    phrases = a_set(5)
    sets = [a_set(295, phrases) for _ in range(100)]
    seen = Counter(k for s in sets for k in set(part_keys(s, radius).tolist()))
    assert sum(n for n in seen.values() if n > 1) <= 30  # 67 where parts came in any order
    for s in sets[:20]:  # the most that two linked sets can differ in
        linked = np.unique(np.concatenate([s[:-33], a_set(33)]))
        assert radius.links(len(np.intersect1d(s, linked)), len(s), len(linked))
        assert np.isin(part_keys(s, radius), part_keys(linked, radius)).any()
