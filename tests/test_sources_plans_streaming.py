"""CSV sources (S1-S4), store (S7-S12, J11), sweeps (J10, X1, X3, C10, W5), pipelines and streaming."""

import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from sextant.operators import evaluate as E
from sextant.operators import kmeans as K
from sextant.plans import config as G
from sextant.plans import pipeline as PL
from sextant.sources import csv as S
from sextant.sources import store as ST
from sextant.streaming.ingest import start_candidate_stream

CSV_A = 'id,intent,text\n0,Make Update,"We are updating packages, ""now"""\n1,None,Nothing here\n'
CSV_B = 'id,text,intent\n0,"Ordering tickets, please",FindConnection\n1,Was tun?,DepartureTime\n'


def _folder(files):
    d = tempfile.mkdtemp(prefix="sextant-test-")
    for name, body in files.items():
        with open(os.path.join(d, name), "w") as f:
            f.write(body)
    return d


def test_read_utterances_binds_by_name(spark):
    d = _folder({"a.csv": CSV_A})
    rows = S.read_utterances(spark, os.path.join(d, "a.csv")).orderBy("id").collect()
    assert rows[0]["text"] == 'We are updating packages, "now"' and rows[0]["intent"] == "Make Update"
    assert rows[1]["intent"] == "None"  # the literal string, not a missing value


def test_read_dataset_dir(spark):
    d = _folder({"askubuntu.csv": CSV_A, "chatbot.csv": CSV_B, "demo_x.csv": CSV_B})
    df = S.read_dataset_dir(spark, d, exclude="demo")
    got = sorted((r["dataset"], r["id"], r["intent"]) for r in df.collect())
    assert got == [("askubuntu", 0, "Make Update"), ("askubuntu", 1, "None"),
                   ("chatbot", 0, "FindConnection"), ("chatbot", 1, "DepartureTime")]


def test_stage_csv_round_trip(spark):
    d = tempfile.mkdtemp(prefix="sextant-test-")
    df = spark.createDataFrame([(0, "a, b", "x")], "id long, text string, label string")
    S.write_stage_csv(S.normalise_truth_column(df), os.path.join(d, "stage"))
    back = S.read_stage_csv(spark, os.path.join(d, "stage")).first()
    assert back["text"] == "a, b" and back["intent"] == "x"


def test_config_key_and_store(spark):
    cfg = {"dataset": "snips", "embedding_model_name": "use", "clustering_algorithm": "dbscan",
           "clustering_measure": "silhouette", "extraction_method": "liu", "generation_method": "most-frequent"}
    assert ST.config_key(cfg, "embedding_model_name") == "snips_use"
    assert ST.config_key(cfg) == "snips_use_dbscan_silhouette_liu_most-frequent"
    root = tempfile.mkdtemp(prefix="sextant-store-")
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    assert ST.materialize(spark, root, "k", build).count() == 3
    assert ST.materialize(spark, root, "k", build).count() == 3
    assert len(calls) == 1  # reused the second time
    wanted = spark.createDataFrame([("c", 0), ("c", 1)], "config string, param_idx int")
    stored = spark.createDataFrame([("c", 0)], "config string, param_idx int")
    assert [r["param_idx"] for r in ST.missing_attempts(wanted, stored).collect()] == [1]


def test_metric_json(spark):
    root = tempfile.mkdtemp(prefix="sextant-metric-")
    df = spark.createDataFrame([("cfg", "a", 0.5), ("cfg", "b", 1.0)], "config string, intent string, score double")
    ST.write_metric(df, os.path.join(root, "m"))
    assert ST.read_metric_avg(spark, os.path.join(root, "m")).first()["avg"] == 0.75


def test_sweep_grid_order_and_exclusions(spark):
    opts = {"dataset": ["d"], "embedding_model_name": ["bert-base-uncased", "all-mpnet-base-v2", "use"],
            "clustering_algorithm": ["kmeans", "dbscan", "iter_dbscan"], "clustering_measure": ["silhouette"],
            "extraction_method": ["liu", "prompting"], "generation_method": G.GENERATION_METHODS}
    grid = G.sweep_grid(spark, opts)
    rows = grid.orderBy("combo_idx").collect()
    import itertools
    want = list(itertools.product(*[opts[f] for f in ST.CONFIG_FIELDS]))
    assert [tuple(r[f] for f in ST.CONFIG_FIELDS) for r in rows] == want
    kept = G.sweep_exclude(grid, [8, 9, 10, 11, 20, 21, 22, 23])
    assert kept.count() == 28
    assert G.sweep_for_dataset(grid, "d").count() == 36
    finished = spark.createDataFrame([(ST.config_key(dict(zip(ST.CONFIG_FIELDS, want[0]))),)], "config string")
    assert G.sweep_pending(grid, finished).count() == 35


def test_hyperparameter_grid(spark):
    assert G.hyperparameter_grid(spark).count() == 1500
    d = G.hp_distances()
    assert d[5] == 0.01 + 5 * 0.01 and len(d) == 10
    draws = G.draw_hyperparameters(spark, 100)
    assert draws.count() == 100 and draws.select("param_idx").distinct().count() == 100
    assert draws.collect() == G.draw_hyperparameters(spark, 100).collect()  # seeded


def test_validate():
    G.validate({"clustering_algorithm": "dbscan", "extraction_method": "liu"})
    try:
        G.validate({"clustering_algorithm": "deep-aligned"})
        raise AssertionError("expected ValueError")
    except ValueError:
        pass


def test_best_config(spark):
    m = spark.createDataFrame([(0, 0.2), (1, 0.5), (2, 0.5)], "combo_idx int, avg double")
    assert E.best_config(m).first()["combo_idx"] == 1


def test_kmeans_lloyd_and_sweep(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 0.1, (10, 3)), rng.normal(5, 0.1, (10, 3))])
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, embedding array<double>")
    lab, c = K.lloyd(v, x[[0, 10]], 2)
    got = [r["cluster_id"] for r in lab.orderBy("id").collect()]
    assert got == [0] * 10 + [1] * 10
    assert list(K.clamp_k_range(5)) == [2, 3, 4]
    sw = K.kmeans_sweep(v, [2, 3], parallelism=2)
    assert sw.groupBy("param_idx").count().count() == 2


def test_run_configuration_end_to_end(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    utts = d.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("intent"))
    cfg = {"dataset": "docs", "embedding_model_name": "use", "clustering_algorithm": "dbscan",
           "clustering_measure": "silhouette", "extraction_method": "liu", "generation_method": "most-frequent"}
    rows = PL.run_configuration(utts, cfg)
    assert rows.count() == 200
    assert set(rows.columns) >= {"id", "cluster_id", "candidate_intent", "generated"}


def test_streaming_candidates(spark):
    src = _folder({"askubuntu.csv": CSV_A, "chatbot.csv": CSV_B})
    out = tempfile.mkdtemp(prefix="sextant-out-")
    ck = tempfile.mkdtemp(prefix="sextant-ck-")
    q = start_candidate_stream(spark, src, os.path.join(out, "cands"), ck)
    q.awaitTermination(120)
    res = spark.read.parquet(os.path.join(out, "cands"))
    got = {(r["dataset"], r["id"]): (r["intent"], r["candidate_intent"]) for r in res.collect()}
    assert got[("askubuntu", 0)] == ("Make Update", "updating-packages")
    assert got[("chatbot", 0)] == ("FindConnection", "Ordering-tickets")
    assert got[("chatbot", 1)][1] == "NONE"
