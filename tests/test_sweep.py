"""A whole sweep: stages are stored and shared, a second run builds nothing, models are injected."""

import pytest

from sextant.plans import pipeline as P


def injected(**more):
    """Models as local functions, which travel to the workers by value."""
    def encode(texts):
        # texts about cards, about transfers, and others, far from each other
        import numpy as np
        out = np.full((len(texts), 3), 0.01)
        for k, t in enumerate(texts):
            out[k, 0 if "card" in t else 1 if "transfer" in t else 2] += 1 + 0.001 * (len(t) % 7)
        return out

    def score(sources, targets):
        return [float(len(set(a.split()) & set(b.split()))) for a, b in zip(sources, targets)]

    return P.Models(encode=encode, score=score, **more)


def test_sweep_builds_each_stage_once(spark, tmp_path, monkeypatch):
    rows = [(k, f"{verb} the {thing} station today", f"{thing}_{verb}") for k, (verb, thing) in enumerate(
        [("ordering", "card"), ("blocked", "card"), ("sending", "transfer"), ("stopped", "transfer")] * 6)]
    utts = spark.createDataFrame(rows, "id long, text string, intent string")
    grid = spark.createDataFrame(
        [(k, "banking77", "all-mpnet-base-v2", "iter_dbscan", "silhouette", method, "most-frequent") for k, method in enumerate(["action-object", "action-object-ext"])],
        "combo_idx int, dataset string, embedding_model_name string, clustering_algorithm string, clustering_measure string, "
        "extraction_method string, generation_method string")
    settings = [{"initial_distance": 0.1, "initial_minimum_samples": 4, "delta_distance": 0.01, "delta_minimum_samples": 1, "max_iteration": 2},
                {"initial_distance": 0.2, "initial_minimum_samples": 3, "delta_distance": 0.01, "delta_minimum_samples": 1, "max_iteration": 1}]
    models = injected(iter_dbscan_params=settings)
    built = {"attempts": 0}
    attempts = P.attempts
    monkeypatch.setattr(P, "attempts", lambda *a: (built.__setitem__("attempts", built["attempts"] + 1), attempts(*a))[1])
    store = str(tmp_path / "store")
    first = sorted(tuple(r) for r in P.run_sweep(spark, utts, grid, models, store).collect())
    assert [r[0] for r in first] == [0, 1] and all(r[1] is not None and r[2] is not None for r in first)
    assert built["attempts"] == 1  # shared by both configurations
    best = {r["metric"]: (r["combo_idx"], r["score"]) for r in P.best_of_sweep(P.run_sweep(spark, utts, grid, models, store)).collect()}
    assert best == {m: (min(r[0] for r in first if r[k] == max(x[k] for x in first)), max(x[k] for x in first)) for m, k in (("avg", 1), ("avg_score", 2))}
    configs = [{k: v for k, v in r.asDict().items() if k != "combo_idx"} for r in grid.collect()]
    told = P.stored_metrics(spark, store, configs).collect()
    assert [r["avg"] for r in told] == pytest.approx([r[1] for r in first])

    def fail(*_, **__):
        raise AssertionError("built again")
    for name in ("attempts", "best_labels", "generate_labels", "evaluate_configuration"):
        monkeypatch.setattr(P, name, fail)
    assert sorted(tuple(r) for r in P.run_sweep(spark, utts, grid, models, store).collect()) == first


def test_plain_case_names_stay_whole(spark):
    rows = spark.createDataFrame([(0, 0, "card_arrival", "card-arrival"), (1, 0, "card_arrival", "card-arrival")],
                                 "id long, cluster_id int, intent string, generated string")
    rep, per, scores = P.evaluate_configuration(rows, "banking77", models=injected())
    assert rep.first()["cosine_sim"] == pytest.approx(1.0) and rep.first()["bart_score"] == 2.0
    assert scores.first()["bart_score"] == 2.0 and per.first()["cosine_sim"] == pytest.approx(1.0)


def test_drawn_settings_have_the_names_that_the_operator_takes(spark):
    settings = P.iter_dbscan_settings(spark, P.Models())
    assert len(settings) == 100 and set(settings[0]) == {
        "initial_distance", "initial_minimum_samples", "delta_distance", "delta_minimum_samples", "max_iteration"}


def test_an_interrupted_sweep_builds_only_what_is_missing(spark, tmp_path):
    from sextant.sources.store import resumable_attempts

    store, built = str(tmp_path / "store"), []

    def build(some, stop_at=None):
        if stop_at in some:
            raise InterruptedError
        built.append(list(some))
        return spark.createDataFrame([(p, k, p * 10 + k) for p in some for k in range(3)], "param_idx int, id long, cluster_id int")

    with pytest.raises(InterruptedError):
        resumable_attempts(spark, store, "key", [2, 3, 4, 5, 6], lambda some: build(some, stop_at=6), at_once=2)
    assert built == [[2, 3], [4, 5]]
    # rows without an entry in the completion table, as a writer leaves them that stops between the two
    spark.createDataFrame([(6, 0, 99)], "param_idx int, id long, cluster_id int").write.mode("append").partitionBy("param_idx").parquet(f"{store}/key/attempts")
    built.clear()
    found = resumable_attempts(spark, store, "key", [2, 3, 4, 5, 6, 7], build, at_once=2)
    assert built == [[6, 7]]
    assert sorted((r["param_idx"], r["id"], r["cluster_id"]) for r in found.collect()) == [(p, k, p * 10 + k) for p in range(2, 8) for k in range(3)]
    resumable_attempts(spark, store, "key", [3, 7], build)
    assert built == [[6, 7]]
