"""DBSCAN / ITER-DBSCAN / components / quality scores against plain Python restatements
of the published definitions, on hand-built and random vectors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.operators import density as D
from sextant.operators import quality as Q
from sextant.operators.components import connected_components
from sextant.operators.neighbors import cosine_range_join


# ---------------------------------------------------------------- references

def cos_dist_matrix(x):
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
    return np.round(np.clip(1 - u @ u.T, 0, 2), 9)


def ref_dbscan(x, eps, ms):
    """Sequential scan: rows in order, each unvisited core starts the next cluster."""
    d = cos_dist_matrix(x)
    np.fill_diagonal(d, 0)
    n = len(x)
    nb = [np.nonzero(d[i] <= eps)[0] for i in range(n)]
    core = [len(nb[i]) >= ms for i in range(n)]
    lab = [-1] * n
    cid = 0
    for i in range(n):
        if lab[i] != -1 or not core[i]:
            continue
        lab[i] = cid
        stack = [i]
        while stack:
            p = stack.pop()
            for q in nb[p]:
                if lab[q] == -1:
                    lab[q] = cid
                    if core[q]:
                        stack.append(q)
        cid += 1
    return lab


def ref_iter_dbscan(x, eps, ms, deps, dms, max_it, thr):
    lab = np.full(len(x), -1)
    cid = 0
    for _ in range(max_it):
        idx = np.nonzero(lab == -1)[0]
        if len(idx) < 5:
            break
        sub = ref_dbscan(x[idx], eps, ms)
        freq = {c: sub.count(c) for c in set(sub)}
        kept = sorted({c for c in sub if c != -1 and freq[c] <= thr})
        new = {c: cid + k for k, c in enumerate(kept)}
        for j, c in zip(idx, sub):
            if c in new:
                lab[j] = new[c]
        cid += len(kept)
        eps += deps
        ms -= dms
        if ms == 2:
            break
    return list(lab)


def ref_silhouette(x, lab):
    lab = np.asarray(lab)
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    out = []
    for i in range(len(x)):
        own = lab == lab[i]
        n_own = own.sum()
        if n_own == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (n_own - 1)
        b = min(d[i, lab == c].mean() for c in set(lab) if c != lab[i])
        out.append(0.0 if max(a, b) == 0 else (b - a) / max(a, b))
    return out


def ref_davies_bouldin(x, lab):
    lab = np.asarray(lab)
    ks = sorted(set(lab))
    cen = np.array([x[lab == k].mean(0) for k in ks])
    s = np.array([np.sqrt(((x[lab == k] - cen[j]) ** 2).sum(1)).mean() for j, k in enumerate(ks)])
    cd = np.sqrt(((cen[:, None] - cen[None]) ** 2).sum(-1))
    if np.allclose(s, 0) or np.allclose(cd, 0):
        return 0.0
    cd[cd == 0] = np.inf
    return float(np.max((s[:, None] + s[None]) / cd, axis=1).mean())


# ---------------------------------------------------------------- helpers

def vec_df(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)],
                                 "id long, embedding array<double>")


def labels_of(df, col="cluster_id"):
    return [r[col] for r in df.orderBy("id").collect()]


def blobs(seed, n=40, d=6, k=3, spread=0.15):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(k, d))
    pts = centers[rng.integers(0, k, n)] + spread * rng.normal(size=(n, d))
    return pts


# ---------------------------------------------------------------- tests

@pytest.mark.parametrize("seed", [1, 2, 3])
def test_dbscan_matches_sequential_scan(spark, seed):
    x = blobs(seed)
    for eps, ms in [(0.05, 3), (0.1, 5), (0.3, 4)]:
        got = labels_of(D.dbscan(vec_df(spark, x), eps, ms))
        assert got == ref_dbscan(x, eps, ms), (seed, eps, ms)


def test_dbscan_edge_fixtures(spark):
    # chain of near points, a border point between two clusters, a zero vector, duplicates
    x = np.array([
        [1.0, 0.00], [1.0, 0.05], [1.0, 0.10], [1.0, 0.15],   # chain
        [0.0, 1.0], [0.05, 1.0], [0.10, 1.0],                # second group
        [1.0, 1.0],                                          # border between the two?
        [0.0, 0.0],                                          # zero vector: distance 1 to everything
        [1.0, 0.0],                                          # duplicate of row 0
    ])
    for eps, ms in [(0.02, 2), (0.3, 2), (0.3, 3), (0.9, 5)]:
        assert labels_of(D.dbscan(vec_df(spark, x), eps, ms)) == ref_dbscan(x, eps, ms), (eps, ms)


def test_point_at_exact_eps(spark):
    # cos distance of (1,0) and (0,1) is exactly 1.0
    x = np.array([[1.0, 0.0], [0.0, 1.0]])
    edges = cosine_range_join(vec_df(spark, x), 1.0).collect()
    assert [(r["i"], r["j"], r["dist"]) for r in edges] == [(0, 1, 1.0)]
    assert cosine_range_join(vec_df(spark, x), 0.999999).count() == 0


def test_range_join_many_blocks(spark):
    x = blobs(7, n=60)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if cos_dist_matrix(x)[i, j] <= 0.2}
    got = {(r["i"], r["j"]) for r in cosine_range_join(vec_df(spark, x), 0.2, block_rows=7).collect()}
    assert got == want


def test_dbscan_invariant_to_blocks_and_partitions(spark):
    x = blobs(11, n=50)
    a = labels_of(D.dbscan(vec_df(spark, x).repartition(7), 0.1, 4))
    assert a == ref_dbscan(x, 0.1, 4)


def test_sweep_equals_single_runs(spark):
    x = blobs(5, n=30)
    eps_values = D.eps_schedule(0.02, 0.05, 5)
    sweep = D.dbscan_sweep(vec_df(spark, x), eps_values, 4).collect()
    for p, eps in enumerate(eps_values):
        got = [r["cluster_id"] for r in sorted((r for r in sweep if r["param_idx"] == p), key=lambda r: r["id"])]
        assert got == ref_dbscan(x, eps, 4), p


def test_fewer_than_five_rows(spark):
    x = blobs(3, n=4)
    out = D.iter_dbscan(vec_df(spark, x), 0.1, 2, 0.01, 1, 5, 300)
    assert labels_of(out) == [-1, -1, -1, -1]


@pytest.mark.parametrize("params", [(0.02, 6, 0.02, 1, 10, 300), (0.05, 5, 0.03, 1, 4, 8), (0.1, 4, 0.1, 1, 3, 300)])
def test_iter_dbscan_matches_reference(spark, params):
    x = blobs(21, n=60, k=4, spread=0.1)
    eps, ms, deps, dms, it, thr = params
    got = labels_of(D.iter_dbscan(vec_df(spark, x), eps, ms, deps, dms, it, thr))
    assert got == ref_iter_dbscan(x, eps, ms, deps, dms, it, thr)


def test_iter_dbscan_radius_beyond_two(spark):
    x = blobs(4, n=12)
    for params in [(1.5, 3, 0.6, 0, 3, 5), (1.9, 2, 0.2, 0, 3, 300)]:
        got = labels_of(D.iter_dbscan(vec_df(spark, x), *params))
        assert got == ref_iter_dbscan(x, *params), params


def test_connected_components_path(spark):
    n = 40
    order = list(range(n))
    random.Random(3).shuffle(order)
    edges = [(order[k], order[k + 1]) for k in range(n - 1) if k != 19]
    nodes = spark.createDataFrame([(i,) for i in range(n)], "id long")
    e = spark.createDataFrame(edges, "i long, j long")
    roots = {r["id"]: r["root"] for r in connected_components(nodes, e).collect()}
    assert roots[order[0]] == min(order[:20]) and roots[order[39]] == min(order[20:])
    assert len(set(roots.values())) == 2


def _union_find_roots(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in range(n)}


def test_connected_components_random_keyed_graphs(spark):
    """Several graphs solved together (one per key) against union-find."""
    rng = random.Random(11)
    node_rows, edge_rows, want = [], [], {}
    shapes = ["sparse", "clique", "path", "star", "empty"]
    for key, shape in enumerate(shapes * 2):
        n = rng.randint(20, 60)
        ids = list(range(n))
        rng.shuffle(ids)
        if shape == "sparse":
            edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(n)]
        elif shape == "clique":
            half = ids[: n // 2]
            edges = [(a, b) for a in half for b in half if a < b]
        elif shape == "path":
            edges = [(ids[t], ids[t + 1]) for t in range(n - 1)]
        elif shape == "star":
            edges = [(n - 1, t) for t in range(0, n - 1, 2)]
        else:
            edges = []
        node_rows += [(key, i) for i in range(n)]
        edge_rows += [(key, a, b) for a, b in edges]
        want.update({(key, i): r for i, r in _union_find_roots(n, edges).items()})
    nodes = spark.createDataFrame(node_rows, "g int, id long")
    e = spark.createDataFrame(edge_rows, "g int, i long, j long")
    got = {(r["g"], r["id"]): r["root"] for r in connected_components(nodes, e, ["g"]).collect()}
    assert got == want


def test_connected_components_that_collapse_in_the_first_contraction(spark):
    n = 60
    nodes = spark.createDataFrame([(i,) for i in range(2 * n)], "id long")
    pairs = spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(n)], "i long, j long")
    for edges_per_task in (5, 1000):
        roots = {r["id"]: r["root"] for r in connected_components(nodes, pairs, edges_per_task=edges_per_task).collect()}
        assert roots == {i: i - i % 2 for i in range(2 * n)}


def _attempts(spark, labelings):
    rows = [(p, i, int(c)) for p, lab in enumerate(labelings) for i, c in enumerate(lab)]
    return spark.createDataFrame(rows, "param_idx int, id long, cluster_id int")


def test_silhouette_and_davies_bouldin(spark):
    x = blobs(9, n=30, k=3)
    labelings = [ref_dbscan(x, 0.1, 3), [i % 3 for i in range(30)], [0] * 29 + [1],
                 [i // 10 for i in range(30)]]
    v = vec_df(spark, x)
    lab = _attempts(spark, labelings)
    sil = Q.silhouette_samples(v, lab, block_rows=8).collect()
    for p, labeling in enumerate(labelings):
        got = [r["silhouette"] for r in sorted((r for r in sil if r["param_idx"] == p), key=lambda r: r["id"])]
        assert np.allclose(got, ref_silhouette(x, labeling), atol=1e-9), p
    db = {r["param_idx"]: r["davies_bouldin"] for r in Q.davies_bouldin(v, lab, block_rows=2).collect()}
    for p, labeling in enumerate(labelings):
        assert math.isclose(db[p], ref_davies_bouldin(x, labeling), rel_tol=1e-9, abs_tol=1e-12), p


def test_degenerate_guard_and_best(spark):
    x = blobs(2, n=12)
    labelings = [[0] * 12, list(range(12)), [i % 2 for i in range(12)], [i % 3 for i in range(12)]]
    s = {r["param_idx"]: r for r in Q.score_attempts(vec_df(spark, x), _attempts(spark, labelings)).collect()}
    assert s[0]["silhouette"] == float("-inf") and s[0]["davies_bouldin"] == float("inf")
    assert s[1]["balanced"] == float("-inf")  # K = N > N - 1
    best = {r["measure"]: r["param_idx"] for r in Q.best_attempt(
        Q.score_attempts(vec_df(spark, x), _attempts(spark, labelings))).collect()}
    assert best["silhouette"] in (2, 3) and best["davies_bouldin"] in (2, 3)


def test_penalty(spark):
    lab = [0] * 6 + [1] * 3 + [2]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(lab)], "id long, cluster_id int")
    sizes = [6, 3, 1]
    n, k = 10, 3
    want = sum(abs(s / n - 1 / k) for s in sizes) * 0.5 * np.std(sizes, ddof=1) / np.mean(sizes)
    assert math.isclose(Q.size_penalty(df).first()["penalty"], want, rel_tol=1e-12)


def test_cap_and_renumber(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate([5, 5, 5, 9, 9, -1, 7])], "id long, cluster_id int")
    capped = {r["id"]: r["cluster_id"] for r in D.cap_cluster_size(df, 2).collect()}
    assert capped == {0: -1, 1: -1, 2: -1, 3: 9, 4: 9, 5: -1, 6: 7}
    ren = {r["id"]: r["new_id"] for r in D.dense_renumber(df, offset=10).collect()}
    assert ren == {0: 10, 1: 10, 2: 10, 3: 12, 4: 12, 5: -1, 6: 11}


def test_alignment_check(spark):
    v = vec_df(spark, blobs(1, n=5))
    lab = spark.createDataFrame([(0, i, 0) for i in [0, 1, 2, 3, 9]], "param_idx int, id long, cluster_id int")
    r = Q.alignment_check(v, lab).first()
    assert (r["labels_without_vector"], r["vectors_without_label"]) == (1, 1)


def test_strips_beyond_the_radius_are_not_compared(spark):
    """The documents at radius 0.1: clearly fewer than all pairs are compared, and none within it is missed."""
    from sextant.operators import cells
    from sextant.operators.embedding import hashed_embedding

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = hashed_embedding(docs.selectExpr("doc_id as id", "text"), 256).collect()
    x = cells.unit_rows(np.array([r["embedding"] for r in rows], dtype=float))
    x[7] = 0
    block, limit = cells.Block(np.arange(len(x)), x, {}), cells.whole_radius(0.1)
    left, right, may = cells.paired(block, block, True, limit)
    compared = sum((s.stop - s.start) * len(cols) for s, cols in cells.strip_columns(may, 0, len(x), len(x), above=True))
    assert compared < 0.8 * len(x) ** 2 / 2
    whole = slice(0, len(x))
    seen = cells.distances_within(left, right, whole, whole, may, 2 * cells.UNIT) <= limit
    assert np.array_equal(cells.whole_distances(left.x, right.x) <= limit, seen)


@pytest.mark.parametrize("eps", [0.0, 0.05, 0.4, 1.0, 2.0])
def test_range_join_in_cells_equals_all_pairs(spark, eps):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.standard_normal((3, 6)).repeat(100, axis=0) + 0.2 * rng.standard_normal((300, 6)), np.zeros((2, 6)), -np.ones((40, 6))])
    d = np.round(1 - (u := x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)) @ u.T, 9)
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if d[i, j] <= eps}
    got = [(r["i"], r["j"]) for r in cosine_range_join(vec_df(spark, x), eps, block_rows=150).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_forest_paths_for_many_rows_equal_those_for_few(spark):
    """Several blocks, edges merged over tasks and components found together, against the sequential scan; radii not in order."""
    from sextant.operators.cells import extent
    from sextant.operators.spanning import density_roots

    rng = np.random.default_rng(8)
    x = np.concatenate([rng.standard_normal((5, 4)).repeat(12, axis=0) + 0.25 * rng.standard_normal((60, 4)), np.zeros((2, 4))])
    x[20:24] = x[20]
    df = vec_df(spark, x)
    for min_samples, radii in ((1, [0.2]), (4, [0.2, 0.01])):
        roots = density_roots(df, radii, min_samples, size=extent(df, "embedding", block_rows=20), per_task=30)
        got = D.number_clusters(roots, ["param_idx"]).collect()
        for p, eps in enumerate(radii):
            found = [r["cluster_id"] for r in sorted(got, key=lambda r: r["id"]) if r["param_idx"] == p]
            assert found == ref_dbscan(x, eps, min_samples), (eps, min_samples)


def test_forest_of_a_block_pair_has_fewer_edges_than_rows():
    from sextant.operators import cells, spanning

    rng = np.random.default_rng(9)
    x = cells.unit_rows(rng.standard_normal((300, 5)))
    core = np.full(300, 1000, dtype=np.int64)
    a, b = (cells.Block(np.arange(300)[s], x[s], {"core": core[s]}) for s in (slice(0, 140), slice(140, 300)))
    for left, right, same in ((a, a, True), (a, b, False)):
        got = spanning._reach(left, right, same, cells.whole_radius(2.0))
        rows = len(left.ids) + (0 if same else len(right.ids))
        assert len(got["w"]) == rows - 1
        i, j = (left.ids, left.ids) if same else (left.ids, right.ids)
        d = np.maximum(cells.whole_distances(x[i], x[j]), 1000)
        u, v = np.meshgrid(i, j, indexing="ij")
        off = u != v
        keep = spanning.forest_of(d[off], u[off], v[off])
        assert sorted(d[off][keep]) == sorted(got["w"])


def test_kmeans_sweep_shares_its_scans(spark, monkeypatch):
    from sextant.operators import kmeans as K

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal((4, 3)).repeat(40, axis=0) * 8 + rng.standard_normal((160, 3)) * 0.1, np.zeros((3, 3))])
    scans, scan = [], K.lloyd_scan
    monkeypatch.setattr(K, "lloyd_scan", lambda rows, sets: (scans.append(len(sets)), scan(rows, sets))[1])
    df = vec_df(spark, x)
    for ks in ([4], [2, 3, 4, 5, 6, 200]):
        scans.clear()
        labels = K.kmeans_sweep(df, ks, steps=2).collect()
        assert len(scans) <= 3 and {r["param_idx"] for r in labels} == set(ks) and len(labels) == len(ks) * len(x)
    own = {r["id"]: r["cluster_id"] for r in labels if r["param_idx"] == 4}
    assert len({own[k] for k in range(160)}) == 4 and all(len({own[40 * g + k] for k in range(40)}) == 1 for g in range(4))
    rows = K.fit_rows(df, "id", "embedding")
    (centers,), seeds, costs = K.fit_centers(rows, [5], 50, tolerance=1e-12)
    label = ((x[:, None] - centers) ** 2).sum(axis=2).argmin(axis=1)
    assert costs[0] <= seeds[0] and all(np.allclose(centers[c], x[label == c].mean(axis=0)) for c in range(5))


def test_rank_in_groups_of_one_hot_group(spark):
    from sextant.operators.ordering import rank_in_groups
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    rows = [(0 if k % 3 else k % 7, float(rng.integers(0, 50)), k) for k in range(2000)]
    df = spark.createDataFrame(rows, "cluster_id int, sim double, id long").repartition(6)
    got = {r["id"]: r["rank"] for r in rank_in_groups(df, ["cluster_id"], [F.desc("sim"), F.asc("id")]).collect()}
    want = {}
    for c in {r[0] for r in rows}:
        for n, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == c), key=lambda r: (-r[1], r[2]))):
            want[i] = n + 1
    assert got == want


def test_misaligned_attempt_fails_by_name(spark):
    x = np.eye(4)
    lab = spark.createDataFrame([(0, k, k % 2) for k in range(4)] + [(1, k, k % 2) for k in range(3)], "param_idx int, id long, cluster_id int")
    with pytest.raises(Exception, match="MISALIGNED_ATTEMPT: row 3 has no label in attempt 1"):
        Q.silhouette_samples(vec_df(spark, x), lab).collect()
    with pytest.raises(Exception, match="MISALIGNED_ATTEMPT: no vector for the labelled row 9"):
        Q.davies_bouldin(vec_df(spark, x), spark.createDataFrame([(0, k, k % 2) for k in (0, 1, 2, 3, 9)], "param_idx int, id long, cluster_id int")).collect()


def test_silhouettes_of_equal_attempts_by_tiles(spark, monkeypatch):
    """Attempts that equal the one before (with other ids too), many runs, small tiles: as from all distances."""
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(90, 5)).round(3)
    tries = [rnd.integers(0, 6, 90) for _ in range(3)]
    tries = [tries[0], tries[0] - 1, tries[1], tries[2], tries[2], tries[0]]
    monkeypatch.setattr(Q, "SUMS_PER_TASK", 12 * 1024)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>")
    lab = spark.createDataFrame([(a, i, int(c)) for a, t in enumerate(tries) for i, c in enumerate(t)], "param_idx int, id long, cluster_id int")
    packed = Q.Packed(v, lab)
    assert packed.repeats == [False, True, False, False, True, False]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    got = {(r["param_idx"], r["id"]): (r["cluster_id"], r["silhouette"]) for r in Q.silhouette_samples(v, lab, block_rows=40).collect()}
    assert len(got) == 6 * 90
    for a, t in enumerate(tries):
        for i in range(90):
            means = {c: d[i, t == c].sum() / max((t == c).sum() - (c == t[i]), 1) for c in set(t)}
            own, other = means.pop(t[i]), min(means.values())
            assert got[a, i][0] == t[i] and abs(got[a, i][1] - (other - own) / max(own, other)) < 1e-9


def test_silhouette_task_holds_few_distances():
    import tracemalloc

    import pyarrow as pa

    rnd = np.random.default_rng(5)

    def batch(n, own):
        return pa.RecordBatch.from_pydict({"_own": [own] * n, "id": pa.array(np.arange(n)), "embedding": pa.array(list(rnd.normal(size=(n, 4)))),
                                           "codes": pa.array([[i % 3] for i in range(n)], pa.list_(pa.int32())),
                                           "clusters": pa.array([[i % 3] if own else None for i in range(n)], pa.list_(pa.int32()))})
    given = [batch(1500, True), batch(8000, False)]
    tracemalloc.start()
    found = list(Q._fold([3], [0], [0])((0,), iter(given)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in found) == 1500 and peak < 40e6  # all distances of the batch are 96 MB


def test_few_pairs_of_a_tile_get_exact_distances(monkeypatch):
    """Small tiles, so that most tiles only compare what may still matter: same lists and forests as from all distances."""
    from sextant.operators import cells, spanning

    monkeypatch.setattr(spanning, "TILE", 128)
    monkeypatch.setattr(spanning, "FEW", 4)
    dense, whole = [], spanning.distances_within
    monkeypatch.setattr(spanning, "distances_within", lambda *given: (dense.append(1), whole(*given))[1])
    rng = np.random.default_rng(11)
    for spread, eps in ((0.0, 1.09), (0.4, 0.3)):  # all directions; groups that are far from each other
        x = rng.standard_normal((1536, 8)) if not spread else np.abs(rng.standard_normal((30, 8)) ** 3)[rng.integers(0, 30, 1536)] + spread * np.abs(rng.standard_normal((1536, 8)))
        x[700], x[701:704] = 0.0, x[0]
        x = cells.unit_rows(x)
        limit = cells.whole_radius(eps)
        for left, right in ((slice(0, 700), slice(700, 1536)), (slice(0, 1536), slice(0, 1536))):
            same = left == right
            d = cells.whole_distances(x[left], x[right])
            ids = [np.arange(1536)[s] for s in (left, right)]
            u, v = np.meshgrid(*ids, indexing="ij")
            d[u == v] = 4 * cells.UNIT
            a, b = (cells.Block(i, x[i], {}) for i in ids)
            dense.clear()
            got = spanning._nearest(a, a if same else b, same, 4, limit)
            assert len(dense) < (len(ids[0]) // 128 + 1) * (len(ids[1]) // 128 + 1)
            near = {}
            for i, w in zip(got["id"], got["w"]):
                near.setdefault(int(i), []).append(int(w))
            for ax in (0,) if same else (0, 1):
                for i, row in zip(ids[ax], d if ax == 0 else d.T):
                    want = sorted(int(w) for w in np.sort(row)[:4] if w <= limit)
                    assert all(abs(p - q) <= 1 for p, q in zip(sorted(near.get(int(i), [])), want, strict=True))
            core = np.full(1536, 0)
            a, b = (cells.Block(i, x[i], {"core": core[i]}) for i in ids)
            dense.clear()
            got = spanning._reach(a, a if same else b, same, limit)
            assert len(dense) < (len(ids[0]) // 128 + 1) * (len(ids[1]) // 128 + 1) / (2 if same else 1)
            keep = (d <= limit) & (u != v)
            best = spanning.forest_of(d[keep], u[keep], v[keep])
            assert len(best) == len(got["w"]) and np.abs(np.sort(d[keep][best]) - np.sort(got["w"])).max() <= 1


@pytest.mark.parametrize("eps, ms", [(0.1, 5), (0.3, 3), (1.0, 4), (0.05, 2)])
def test_one_radius_alone_equals_a_sweep(spark, monkeypatch, eps, ms):
    from sextant.operators import spanning as S
    from sextant.operators.cells import extent

    rng = np.random.default_rng(7)
    around = rng.normal(size=(6, 8))
    x = np.concatenate([around[k % 6] + rng.normal(size=8) * (0.05 + k % 3 / 4) for k in range(600)]).reshape(600, 8)
    x[[3, 50]], x[100] = x[7], 0.0  # copies, and a row without a direction
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>")
    for block_rows in (None, 90):
        size = extent(v, "embedding", block_rows)
        assert (size.blocks > 1) == (block_rows is not None)
        found = []
        for least in (0, 10**9):
            monkeypatch.setattr(S, "ONE_RADIUS_ROWS", least)
            found.append({(r["id"], r["root"]) for r in S.density_roots(v, [eps], ms, size=size).collect()})
        assert found[0] == found[1]


def test_one_radius_compares_neither_settled_rows_nor_rows_of_one_part(monkeypatch):
    from sextant.operators import radius as R
    from sextant.operators.cells import Block, whole_radius

    rng = np.random.default_rng(3)
    x = rng.normal(size=(2, 64)).repeat(3000, axis=0) + rng.normal(size=(6000, 64)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    block, compared, near = Block(np.arange(6000), x, {"known": np.zeros(6000, dtype=np.int64)}), [], R.Sides.near
    monkeypatch.setattr(R.Sides, "near", lambda self, rows, cols: (compared.append(len(rows) * len(cols)), near(self, rows, cols))[1])
    limit = whole_radius(0.1)
    assert np.bincount(R.some_near(block, block, True, 19, limit)["id"]).tolist() == [19] * 6000
    found = R.parts_of(block, limit)
    assert found["part"].tolist() == [0] * 3000 + [3000] * 3000
    assert sum(compared) < 6000 * 6000 / 4  # each pair was looked at twice before


def test_rows_that_know_their_own_block_spare_the_tiles_between_blocks(monkeypatch):
    from sextant.operators import cells, spanning

    dense, whole = [], spanning.distances_within
    monkeypatch.setattr(spanning, "TILE", 256)
    monkeypatch.setattr(spanning, "distances_within", lambda *given: (dense.append(1), whole(*given))[1])
    x = cells.unit_rows(np.random.default_rng(5).standard_normal((2048, 16)))
    limit = cells.whole_radius(1.09)
    own = [cells.Block(ids, x[ids], {}) for ids in (np.arange(1024), np.arange(1024, 2048))]
    lists = [spanning._nearest(b, b, True, 4, limit) for b in own]
    for b, found in zip(own, lists):
        b.more["known"] = np.zeros(1024, dtype=np.int64)
        np.maximum.at(b.more["known"], found["id"] - b.ids[0], found["w"])
    dense.clear()
    both = [*lists, spanning._nearest(*own, False, 4, limit)]
    assert not dense  # the first row and column of tiles before
    ids, w = (np.concatenate([f[c] for f in both]) for c in ("id", "w"))
    d = cells.whole_distances(x, x)
    np.fill_diagonal(d, 4 * cells.UNIT)
    assert all(np.abs(np.sort(w[ids == i])[:4] - np.sort(d[i])[:4]).max() <= 1 for i in range(2048))

    for b in own:
        b.more["core"] = np.zeros(1024, dtype=np.int64)
    forests = []
    for b in own:
        found = spanning._own_reach(b, limit)
        forests.append({c: found[c][~found["own"]] for c in "wij"})
        at = found["i"][found["own"]] - b.ids[0]
        for name, c in (("radius", "w"), ("root", "j")):
            b.more[name] = np.empty(1024, dtype=np.int64)
            b.more[name][at] = found[c][found["own"]]
    dense.clear()
    between = spanning._reach(*own, False, limit)
    assert len(dense) <= 1  # the first row and column of tiles before
    assert (between["i"] < 1024).all() and (between["j"] >= 1024).all()
    w, i, j = (np.concatenate([f[c] for f in (*forests, between)]) for c in "wij")
    u, v = np.triu_indices(2048, 1)
    keep = d[u, v] <= limit
    want = np.sort(d[u, v][keep][spanning.forest_of(d[u, v][keep], u[keep], v[keep])])
    assert np.abs(np.sort(w[spanning.forest_of(w, i, j)]) - want).max() <= 1


def test_a_sweep_over_blocks_that_look_at_themselves_first_is_the_same(spark, monkeypatch):
    from sextant.operators import spanning as S
    from sextant.operators.cells import extent

    rng = np.random.default_rng(9)
    around = rng.normal(size=(6, 8))
    x = np.concatenate([around[k % 6] + rng.normal(size=8) * (0.05 + k % 3 / 4) for k in range(600)]).reshape(600, 8)
    x[[3, 50]], x[100] = x[7], 0.0  # copies, and a row without a direction
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>")
    size, radii = extent(v, "embedding", 200), [0.02, 0.1, 0.3, 0.7, 1.05]
    monkeypatch.setattr(S, "TILE", 64)
    monkeypatch.setattr(S, "FEW", 4)
    found = []
    for least in (0, 10**9):
        monkeypatch.setattr(S, "ONE_RADIUS_ROWS", least)
        found.append({(r["param_idx"], r["id"], r["root"]) for r in S.density_roots(v, radii, 4, size=size).collect()})
    assert found[0] == found[1] and len(found[0]) == 3000


def test_rounds_of_joins_keep_a_plain_estimate_of_bytes(spark):
    from sextant.session import LARGEST_ESTIMATE, cut_lineage

    kept = cut_lineage(spark.createDataFrame([(k, 1) for k in range(8)], "id long, v int"))
    for _ in range(12):  # as products of products the estimates had tens of thousands of bits by then
        kept = cut_lineage(kept.join(kept.withColumnRenamed("v", "w"), "id").select("id", (F.col("v") + F.col("w")).alias("v")))
    assert kept._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= LARGEST_ESTIMATE
    assert sorted(tuple(r) for r in kept.collect()) == [(k, 4096) for k in range(8)]
    assert kept.dtypes == [("id", "bigint"), ("v", "int")]


@pytest.mark.parametrize("blocks", [2, 7, 8])
def test_waves_hold_every_pair_of_blocks_once(spark, monkeypatch, blocks):
    from sextant.operators import cells

    monkeypatch.setattr(cells, "WAVE_BYTES", 1)
    found = []
    for apart in cells.waves(cells.Extent(100, 4, blocks), 1):
        sent = [tuple(r) for r in cells._to_pairs(spark.range(100), "id", blocks, False, apart).select("id", "_ba", "_bb").collect()]
        assert len(sent) == len(set(sent)) <= 100 * 2 * len(apart)
        pairs = {(a, b) for _, a, b in sent}
        assert not pairs & set(found)
        found += pairs
    assert sorted(found) == [(a, b) for a in range(blocks) for b in range(a + 1, blocks)]
    assert len(cells.waves(cells.Extent(100, 4, blocks), 1)) == blocks // 2  # all in one before


@pytest.mark.parametrize("radii", [[0.1], [0.3], [0.02, 0.1, 0.3, 1.05]])
def test_clusters_from_waves_of_block_pairs_are_the_same(spark, monkeypatch, radii):
    from sextant.operators import cells
    from sextant.operators import spanning as S

    rng = np.random.default_rng(11)
    around = rng.normal(size=(6, 8))
    x = np.concatenate([around[k % 6] + rng.normal(size=8) * (0.05 + k % 3 / 4) for k in range(400)]).reshape(400, 8)
    x[[3, 50]], x[100] = x[7], 0.0  # copies, and a row without a direction
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>")
    want = {tuple(r) for r in S.density_roots(v, radii, 4).collect()}
    monkeypatch.setattr(cells, "WAVE_BYTES", 1)
    monkeypatch.setattr(S, "ONE_RADIUS_ROWS", 0)
    for rows in (400, 3):  # with few rows the edges are thinned between waves
        assert len(cells.waves(cells.Extent(rows, 8, 9), spark.sparkContext.defaultParallelism)) > 1
        got = {tuple(r) for r in S.density_roots(v, radii, 4, size=cells.Extent(rows, 8, 9)).collect()}
        assert got == want and len(got) == 400 * len(radii)


def test_iter_dbscan_leaves_its_labels_on_disk_only(spark):
    import os

    rng = np.random.default_rng(2)
    around = rng.normal(size=(8, 64))
    rows = [(k, (around[k % 8] + rng.normal(size=64) * (0.05 + k % 4 / 20)).tolist()) for k in range(160)]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    kept = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    local = os.path.dirname(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getAbsolutePath())

    def shuffled():
        return {f for at in os.listdir(local) if at.startswith("blockmgr") for _, _, files in os.walk(f"{local}/{at}") for f in files if f.startswith("shuffle")}
    before, files = set(os.listdir(kept)), shuffled()
    labels = D.iter_dbscan(v, 0.02, 6, 0.02, 1, 4, 300)
    left = {f: sum(os.path.getsize(f"{kept}/{f}/{x}") for x in os.listdir(f"{kept}/{f}")) for f in set(os.listdir(kept)) - before}
    assert len({r["id"] for r in labels.collect()}) == 160 and labels.select("cluster_id").distinct().count() > 2
    assert sum(left.values()) < 160 * 64 * 8  # each round kept two copies of the vectors that were left
    assert len(shuffled() - files) < 40
