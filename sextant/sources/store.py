"""Artifact store (S7-S14, J11): stage results as Parquet under a root folder.

Stages are keyed by the configuration prefix (S12) so that configurations
sharing a prefix share the stored result, as the file cache of the original
pipeline does.  A stage is reused when its ``_SUCCESS`` marker exists.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONFIG_FIELDS = ("dataset", "embedding_model_name", "clustering_algorithm",
                 "clustering_measure", "extraction_method", "generation_method")


def config_key(config: dict, stage: str | None = None) -> str:
    """Dataset, then each present field in fixed order, '_'-joined, stopping after ``stage``."""
    parts = [config["dataset"]]
    for field in CONFIG_FIELDS[1:]:
        if field in config and config[field] is not None:
            parts.append(str(config[field]))
        if field == stage:
            break
    return "_".join(parts)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))


def materialize(spark: SparkSession, root: str, key: str,
                build: Callable[[], DataFrame], partition_by: list[str] | None = None) -> DataFrame:
    """Read the stored stage if complete, else build, write and re-read it."""
    path = os.path.join(root, key)
    if not _exists(spark, path):
        w = build().write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(path)
    return spark.read.parquet(path)


def missing_attempts(wanted: DataFrame, stored: DataFrame,
                     keys=("config", "param_idx")) -> DataFrame:
    """The wanted ``(config, param_idx)`` rows not yet stored (left anti join)."""
    return wanted.join(stored.select(*keys).distinct(), list(keys), "left_anti")


def resumable_attempts(spark: SparkSession, root: str, key: str, wanted: list[int], build: Callable[[list[int]], DataFrame],
                       at_once: int = 25) -> DataFrame:
    """The wanted attempts of a sweep, stored by ``param_idx``; only those that are not complete are built.

    ``build`` makes the ``(param_idx, ..)`` rows of the attempts it is given,
    at most ``at_once`` together.  An attempt counts once its row is in the
    completion table, which is written after its rows; what an interrupted
    run left of an attempt is written over.
    """
    path, done_path = os.path.join(root, key, "attempts"), os.path.join(root, key, "complete")

    def pending() -> list[int]:
        every = spark.createDataFrame([(p,) for p in wanted], "param_idx int")
        left = missing_attempts(every, spark.read.schema("param_idx int").parquet(done_path), ("param_idx",)) if _exists(spark, done_path) else every
        return sorted(r["param_idx"] for r in left.collect())  # a sweep's parameters

    todo = pending()
    for at in range(0, len(todo), at_once):
        some = todo[at:at + at_once]
        (build(some).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("param_idx").parquet(path))
        spark.createDataFrame([(p,) for p in some], "param_idx int").coalesce(1).write.mode("append").parquet(done_path)
    return spark.read.parquet(path).where(F.col("param_idx").isin([int(p) for p in wanted]))


def write_metric(df: DataFrame, path: str, key_col: str = "intent", value_col: str = "score",
                 avg_key: str = "avg") -> None:
    """A metric object ``{intent: score, ..., "avg": mean}`` as one JSON line per config.

    ``df`` holds ``(config, intent, score)``; the object is assembled with
    ``map_from_entries`` inside Spark and written by the executors.
    """
    group = [c for c in df.columns if c not in (key_col, value_col)]
    obj = df.groupBy(*group).agg(
        F.map_concat(
            F.map_from_entries(F.collect_list(F.struct(F.col(key_col), F.col(value_col)))),
            F.create_map(F.lit(avg_key), F.avg(value_col)),
        ).alias("metric"))
    obj.select(*group, F.to_json("metric").alias("metric")).write.mode("overwrite").json(path)


def read_metric_avg(spark: SparkSession, path: str, avg_key: str = "avg") -> DataFrame:
    """Read metric objects back and take their ``avg`` entry."""
    df = spark.read.json(path)
    return df.withColumn("avg", F.from_json("metric", "map<string,double>")[avg_key])


def save_json_object(path: str, obj: dict) -> None:
    """S7 for a driver-side object of fixed, small size (a chosen configuration)."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w") as f:
        json.dump(obj, f)
