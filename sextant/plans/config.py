"""Configuration sweeps (J10, J11, X1, X3, C10, S12, W5) as DataFrames.

A configuration is a row of six strings; a sweep is the product of option
lists, generated with ``explode`` (no join).  Option names are validated on
the driver and unsupported ones raise ``ValueError``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.sources.store import CONFIG_FIELDS

# Fixed option lists (must equal the original's supported values).
EMBEDDING_MODELS = ["albert-base-v2", "bert-base-uncased", "roberta-base", "all-mpnet-base-v2", "use"]
CLUSTERING_ALGORITHMS = ["kmeans", "dbscan", "iter_dbscan"]
CLUSTERING_MEASURES = ["balanced", "davies_bouldin", "silhouette"]
EXTRACTION_METHODS = ["action-object", "action-object-ext", "t0pp-prompting"]
GENERATION_METHODS = ["most-frequent", "t0pp-prompting"]
# Notebook aliases accepted for the same methods.
METHOD_ALIASES = {"liu": "action-object", "mine": "action-object-ext", "prompting": "t0pp-prompting",
                  "action_object_top_1": "most-frequent"}
# ITER-DBSCAN hyperparameter options.
HP_DISTANCE_START, HP_DISTANCE_STEP, HP_DISTANCE_COUNT = 0.01, 0.01, 10
HP_MIN_SAMPLES = [5, 15, 25, 35, 45]
HP_DELTA_MIN_SAMPLES = [1]
HP_MAX_ITERATION = [25, 50, 75]


def canonical(name: str) -> str:
    return METHOD_ALIASES.get(name, name)


def validate(config: dict) -> dict:
    """Driver-side option check; unknown names raise instead of returning None."""
    allowed = {"embedding_model_name": EMBEDDING_MODELS, "clustering_algorithm": CLUSTERING_ALGORITHMS,
               "clustering_measure": CLUSTERING_MEASURES, "extraction_method": EXTRACTION_METHODS,
               "generation_method": GENERATION_METHODS}
    for field, options in allowed.items():
        if field in config and canonical(config[field]) not in options:
            raise ValueError(f"unsupported {field}: {config[field]!r}")
    return config


def sweep_grid(spark: SparkSession, options: dict[str, list[str]]) -> DataFrame:
    """Product of the option lists in field order, with ``combo_idx`` in product order.

    Generated by chained ``explode`` from one row; ``combo_idx`` is the
    mixed-radix position, equal to the order of ``itertools.product``.
    """
    df = spark.range(1).select(F.lit(0).alias("combo_idx"))
    for field in CONFIG_FIELDS:
        values = options[field]
        df = df.select("*", F.posexplode(F.array(*[F.lit(v) for v in values])).alias(f"_{field}_pos", field))
        df = df.withColumn("combo_idx", F.col("combo_idx") * len(values) + F.col(f"_{field}_pos")) \
               .drop(f"_{field}_pos")
    return df.select("combo_idx", *CONFIG_FIELDS)


def config_key_col(stage: str | None = None):
    """S12 as a column: '_'-join of the present fields up to ``stage`` (nulls skipped)."""
    fields = []
    for f in CONFIG_FIELDS:
        fields.append(f)
        if f == stage:
            break
    return F.concat_ws("_", *[F.col(f) for f in fields])


def sweep_exclude(grid: DataFrame, combo_indices: list[int]) -> DataFrame:
    """Drop listed product positions (e.g. unsupported algorithm/encoder pairs)."""
    return grid.where(~F.col("combo_idx").isin(combo_indices))


def sweep_for_dataset(grid: DataFrame, dataset: str) -> DataFrame:
    """The combinations of one dataset."""
    return grid.where(F.col("dataset") == dataset)


def sweep_pending(grid: DataFrame, finished: DataFrame) -> DataFrame:
    """Combinations whose result is not stored yet (anti join on the config key)."""
    keyed = grid.withColumn("config", config_key_col())
    return keyed.join(finished.select("config"), "config", "left_anti")


def hp_distances() -> list[float]:
    """``start + i * step`` values, as an arange produces them."""
    return [HP_DISTANCE_START + i * HP_DISTANCE_STEP for i in range(HP_DISTANCE_COUNT)]


def hyperparameter_grid(spark: SparkSession) -> DataFrame:
    """The full option grid, 10 x 5 x 10 x 1 x 3 = 1,500 rows, with ``grid_idx``."""
    dist = hp_distances()
    cols = [("distance", dist, "double"), ("minimum_samples", HP_MIN_SAMPLES, "int"),
            ("delta_distance", dist, "double"), ("delta_minimum_samples", HP_DELTA_MIN_SAMPLES, "int"),
            ("max_iteration", HP_MAX_ITERATION, "int")]
    df = spark.range(1).select(F.lit(0).alias("grid_idx"))
    for name, values, typ in cols:
        df = df.select("*", F.posexplode(F.array(*[F.lit(v).cast(typ) for v in values])).alias("_p", name))
        df = df.withColumn("grid_idx", F.col("grid_idx") * len(values) + F.col("_p")).drop("_p")
    return df


def draw_hyperparameters(spark: SparkSession, n: int = 100, seed: str = "hp") -> DataFrame:
    """``n`` seeded draws with replacement from the grid -> ``param_idx`` + settings.

    Draw ``k`` takes grid row ``int(md5(seed || k)[:8], 16) mod 1500`` (fixes B9:
    deterministic, no import side effects).
    """
    grid = hyperparameter_grid(spark)
    size = HP_DISTANCE_COUNT * len(HP_MIN_SAMPLES) * HP_DISTANCE_COUNT * len(HP_DELTA_MIN_SAMPLES) \
        * len(HP_MAX_ITERATION)
    draws = spark.range(n).select(
        F.col("id").cast("int").alias("param_idx"),
        (F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("id").cast("string"))), 1, 8), 16, 10)
         .cast("long") % size).alias("grid_idx"))
    return draws.join(F.broadcast(grid), "grid_idx").drop("grid_idx")  # grid: 1,500 fixed rows
