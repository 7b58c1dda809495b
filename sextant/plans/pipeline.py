"""End-to-end pipelines (section 3 of the survey): one configuration, a sweep, stage precompute.

Stages share results through the artifact store: embeddings are keyed by
(dataset, encoder), clustering attempts by + algorithm, the chosen labeling
by + measure, candidates by (dataset, extraction method).  Every stage is a
Spark job over all rows; the driver only loops over settings.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.operators import candidates as C
from sextant.operators import density as D
from sextant.operators import evaluate as E
from sextant.operators import kmeans as K
from sextant.operators import labels as L
from sextant.operators import prompts as P
from sextant.operators import quality as Q
from sextant.operators.embedding import hashed_embedding
from sextant.operators.inference import embed, first_candidate_responder
from sextant.plans.config import canonical, draw_hyperparameters, validate
from sextant.session import cut_lineage
from sextant.sources.store import config_key, materialize, read_metric_avg, resumable_attempts, write_metric

# Default sweep settings (fixed values of the original configuration).
KMEANS_K_RANGE = (2, 200)
DBSCAN_EPS0, DBSCAN_STEP, DBSCAN_RUNS, DBSCAN_MIN_SAMPLES = 0.10, 0.01, 100, 5

# Attempts that are built and stored together; the radii of DBSCAN share their passes, so all of them are.
ATTEMPTS_AT_ONCE = {"kmeans": 50, "iter_dbscan": 10}


@dataclass
class Models:
    """Injected model functions; the defaults are the deterministic built-ins."""
    encode: Callable | None = None            # list[str] -> (n, d) array; None: hashed embedding
    embed_dim: int = 256
    generate: Callable[[str], str] = first_candidate_responder
    score: Callable | None = None             # (sources, targets) -> scores; None: the built-in scorer
    iter_dbscan_params: list[dict] = field(default_factory=list)  # empty: drawn settings (C10)
    readable: dict | None = None              # further readable intents, dataset -> raw -> readable


def _stored(spark: SparkSession, store: str | None, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """S10 where there is a store; else the stage is built each time."""
    return build() if store is None else materialize(spark, store, key, build)


def iter_dbscan_settings(spark: SparkSession, models: Models) -> list[dict]:
    """C11: the given settings, or the drawn ones under the names that the operator takes."""
    if models.iter_dbscan_params:
        return models.iter_dbscan_params
    drawn = draw_hyperparameters(spark).orderBy("param_idx").collect()  # a fixed number of settings
    return [{"initial_distance": r["distance"], "initial_minimum_samples": r["minimum_samples"], "delta_distance": r["delta_distance"],
             "delta_minimum_samples": r["delta_minimum_samples"], "max_iteration": r["max_iteration"]} for r in drawn]


def embeddings(utts: DataFrame, config: dict, models: Models, store: str | None = None) -> DataFrame:
    """Stage 1a: ``(id, embedding)`` for the configured encoder."""
    def build():
        if models.encode is None:
            return hashed_embedding(utts.select("id", "text"), models.embed_dim)
        return embed(utts.select("id", "text"), models.encode)
    if store is None:
        return build()
    return materialize(utts.sparkSession, store, config_key(config, "embedding_model_name") + "/embeddings", build)


def settings(vectors: DataFrame, config: dict, models: Models) -> list:
    """The configured algorithm's parameter of every attempt, by ``param_idx`` (k itself for k-means)."""
    algo = config["clustering_algorithm"]
    if algo == "kmeans":
        return list(K.clamp_k_range(vectors.count(), *KMEANS_K_RANGE))
    if algo == "dbscan":
        return D.eps_schedule(DBSCAN_EPS0, DBSCAN_STEP, DBSCAN_RUNS)
    if algo == "iter_dbscan":
        return iter_dbscan_settings(vectors.sparkSession, models)
    raise ValueError(f"unsupported clustering algorithm {algo!r}")


def attempts(vectors: DataFrame, config: dict, models: Models, some: list[int] | None = None) -> DataFrame:
    """Stage 1b: clustering attempts of the configured algorithm, all or those of ``some`` indices -> ``(param_idx, id, cluster_id)``."""
    algo, given = config["clustering_algorithm"], settings(vectors, config, models)
    if algo == "kmeans":
        return K.kmeans_sweep(vectors, given if some is None else some)
    some = list(range(len(given))) if some is None else some
    if algo == "dbscan":
        found = D.dbscan_sweep(vectors, [given[p] for p in some], DBSCAN_MIN_SAMPLES)
        return found.withColumn("param_idx", F.element_at(F.array(*[F.lit(p) for p in some]), F.col("param_idx") + 1))
    runs = [D.iter_dbscan(vectors, **given[p]).withColumn("param_idx", F.lit(p)) for p in some]
    return reduce(DataFrame.unionByName, runs).select("param_idx", "id", "cluster_id")


def kept_attempts(vectors: DataFrame, config: dict, models: Models, store: str | None = None) -> DataFrame:
    """Stage 1b with a store: attempts that it has are not built again, also those of a sweep that was interrupted."""
    if store is None:
        return attempts(vectors, config, models)
    given = settings(vectors, config, models)
    wanted = given if config["clustering_algorithm"] == "kmeans" else list(range(len(given)))
    key = config_key(config, "clustering_algorithm")
    found = resumable_attempts(vectors.sparkSession, store, key, wanted, lambda some: attempts(vectors, config, models, some),
                               ATTEMPTS_AT_ONCE.get(config["clustering_algorithm"], len(wanted)))
    return found.select("param_idx", "id", "cluster_id")


def best_labels(vectors: DataFrame, tries: DataFrame, measure: str) -> DataFrame:
    """Stage 1c: the best attempt by the measure -> ``(id, cluster_id)``."""
    scores = Q.score_attempts(vectors, tries)
    best = Q.best_attempt(scores, measures=(measure,)).first()["param_idx"]
    return tries.where(F.col("param_idx") == best).select("id", "cluster_id")


def generate_labels(rows: DataFrame, config: dict, models: Models, vectors: DataFrame | None = None) -> DataFrame:
    """Stage 2b: ``(cluster_id, generated)`` by most-frequent candidate or by prompts."""
    method = canonical(config["generation_method"])
    if method == "most-frequent":
        return L.label_most_frequent(rows)
    order = None
    if config.get("clustering_algorithm") == "kmeans" and vectors is not None:
        cents = Q.centroids(vectors, rows.select("id", "cluster_id"))
        sims = L.centroid_similarity(vectors.join(rows.select("id", "cluster_id"), "id"), cents)
        ranked = L.order_by_centroid(sims).select("cluster_id", "id", "rank")
        texts = ranked.join(rows.select("id", "text"), "id")
        first = L.dedup_keep_first(texts, "cluster_id", "rank", "text")
        order = ranked.join(first.select("cluster_id", "rank"), ["cluster_id", "rank"])
    return P.label_by_prompt(rows, models.generate, 3, order=order)


def candidates(utts: DataFrame, config: dict, models: Models, store: str | None = None) -> DataFrame:
    """Stage 2a: the candidate of every utterance, by dataset and extraction method."""
    key = f"{config['dataset']}_{config['extraction_method']}/candidates"
    return _stored(utts.sparkSession, store, key, lambda: C.extract(utts, config["extraction_method"], generate=models.generate))


def run_configuration(utts: DataFrame, config: dict, models: Models | None = None,
                      store: str | None = None) -> DataFrame:
    """Entry 1: one configuration -> rows ``(id, text, intent, cluster_id, candidate_intent, generated)``."""
    models = models or Models()
    validate(config)
    spark = utts.sparkSession
    vectors = embeddings(utts, config, models, store)
    tries = kept_attempts(vectors, config, models, store)
    labels = _stored(spark, store, config_key(config, "clustering_measure") + "/labels",
                     lambda: best_labels(vectors, tries, config["clustering_measure"]))
    cands = candidates(utts, config, models, store)
    rows = cands.join(labels, "id")
    gen = generate_labels(rows, config, models, vectors)
    return rows.join(gen, "cluster_id", "left")


def evaluate_configuration(rows: DataFrame, dataset: str, dim: int = 256, models: Models | None = None
                           ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stage 3 for one configuration: label report, and the cosine and the scorer's metric per intent."""
    models = models or Models()
    readable = E.readable_table(rows.sparkSession, models.readable)
    rep = E.label_report(rows, dataset=dataset, dim=dim, readable=readable, encode=models.encode, scorer=models.score)
    per = E.average_per_intent(rep, rows.select("intent"), "cosine_sim", 0.0)
    return rep, per, E.score_per_intent(rep, rows.select("intent"), models.score)


def run_sweep(spark: SparkSession, utts: DataFrame, grid: DataFrame, models: Models | None = None,
              store: str | None = None, dataset: str = "dataset") -> DataFrame:
    """Entry 2: every configuration of ``grid`` -> ``(combo_idx, avg, avg_score)``; W5 picks the best by either.

    The option grid is a handful of rows, so the driver iterates over it;
    every configuration itself is a set of Spark jobs over all utterances.
    With a ``store``, stages that configurations share are built once, a
    configuration whose metric is stored is not run again, and each has its
    metric objects by intent beside it (S7), which :func:`stored_metrics` reads.
    """
    models, results = models or Models(), []
    for row in grid.orderBy("combo_idx").collect():  # the option grid, not data
        config = {k: row[k] for k in row.asDict() if k != "combo_idx"}

        def metric(config=config):
            rows = run_configuration(utts, config, models, store)
            _, per, scores = evaluate_configuration(rows, config.get("dataset") or dataset, models=models)
            if store is not None:
                per, scores = cut_lineage(per), cut_lineage(scores)  # written and averaged
                for found, column in ((per, "cosine_sim"), (scores, "bart_score")):
                    named = found.select(F.lit(config_key(config)).alias("config"), "intent", F.col(column).alias("score"))
                    write_metric(named, f"{store}/{config_key(config)}/{column}")
            return E.macro_average(per, "cosine_sim").crossJoin(  # one row each
                E.macro_average(scores, "bart_score").withColumnRenamed("avg", "avg_score"))

        done = _stored(spark, store, config_key(config) + "/metric", metric)
        results.append(done.withColumn("combo_idx", F.lit(row["combo_idx"])))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.select("combo_idx", "avg", "avg_score")


def best_of_sweep(results: DataFrame) -> DataFrame:
    """``(metric, combo_idx, score)``: the best configuration of a sweep by either metric; ties -> the first combination."""
    best = [E.best_config(results, "combo_idx", m).select(F.lit(m).alias("metric"), "combo_idx", F.col(m).alias("score")) for m in ("avg", "avg_score")]
    return best[0].unionByName(best[1])


def stored_metrics(spark: SparkSession, store: str, configs: list[dict], column: str = "cosine_sim") -> DataFrame:
    """``(config, metric, avg)`` from the stored metric objects of the configurations."""
    return reduce(DataFrame.unionByName, [read_metric_avg(spark, f"{store}/{config_key(c)}/{column}") for c in configs])


def precompute(utts: DataFrame, configs: list[dict], models: Models | None = None,
               store: str | None = None) -> dict[str, DataFrame]:
    """Entry 3: materialise the embedding and candidate stages for each configuration."""
    models = models or Models()
    out = {}
    for config in configs:
        out[config_key(config, "embedding_model_name")] = embeddings(utts, config, models, store)
        if "extraction_method" in config:
            out[f"{config['dataset']}_{config['extraction_method']}"] = candidates(utts, config, models, store)
    return out
