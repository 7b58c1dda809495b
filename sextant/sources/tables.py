"""Parquet table access and the utterance views the operators start from."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.session import spread

#: Turns that a conversation may have for its turns to be numbered in one LONG.
TURNS = 1_000_000
DEFAULT_SF_DIR = "/root/testdata/sf0.01"
# Tables whose rows carry long texts: per-row work on them is CPU-heavy.
TEXT_TABLES = {"documents", "conversations", "pages"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one parquet table; Catalyst prunes columns and pushes filters.

    Text tables are spread over all cores when the scan has fewer splits.
    """
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return spread(df) if name in TEXT_TABLES else df


def documents_utterances(spark: SparkSession, sf_dir: str, intent_col: str = "lang") -> DataFrame:
    """``documents`` as an utterance table ``(id, text, intent)``."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), "text", F.col(intent_col).alias("intent"))


def turn_key(conv: str, turn: str) -> Column:
    """One LONG per (conversation, turn), in that order; fails where a number of turns would merge two."""
    fits = F.col(turn).between(0, TURNS - 1)
    return F.when(fits, F.col(conv) * TURNS + F.col(turn)).otherwise(
        F.raise_error(F.concat(F.lit(f"a turn is not below {TURNS}: "), F.col(turn).cast("string"))).cast("long"))


def conversation_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` turns as utterances, id = (conv_id, turn) packed in one LONG."""
    c = table(spark, sf_dir, "conversations")
    return c.select(turn_key("conv_id", "turn").alias("id"),
                    "conv_id", "turn", "role", "text")


def embedding_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as ``(id, embedding ARRAY<DOUBLE>, label)``."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"),
                    F.col("embedding").cast("array<double>").alias("embedding"), "label")
