"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sextant.llm import language, quality
from sextant.llm.common import table
from sextant.llm.decontamination import ORACLE_OP9, contamination
from sextant.llm.exact_dedup import ORACLE_OP13, exact_dedup
from sextant.llm.jaccard import jaccard_components
from sextant.llm.neighbours import learned_partition_search
from sextant.llm.packing import best_fit_pack
from sextant.llm.phrases import ORACLE_OP6, remove_repeated_windows
from sextant.llm.prefix_trie import ORACLE_OP12, prefix_trie
from sextant.llm.sharding import bounded_ring_shards
from sextant.llm.suffixes import remove_repeated_bytes
from sextant.llm.token_counts import token_counts
from sextant.llm.whitening import whiten


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")), threshold=0.7)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.train(docs))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents"), length=100)


def op6_phrase_automata_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(table(spark, sf_dir, "documents"), window=35)


def op7_bounded_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounded_ring_shards(table(spark, sf_dir, "documents"), n_shards=24)


def op8_learned_partition_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned_partition_search(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op11_qdwh_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), n_components=4)


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_perfect_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_token_counts, op3_quality_classifier, op4_language_id, op5_suffix_array_dedup, op6_phrase_automata_dedup, op7_bounded_ring_sharding,
                                  op8_learned_partition_neighbours, op9_benchmark_decontamination, op10_best_fit_packing, op11_qdwh_whitening, op12_conversation_prefix_trie, op13_perfect_hash_dedup)}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {"op6_phrase_automata_dedup": ORACLE_OP6, "op9_benchmark_decontamination": ORACLE_OP9,
                              "op12_conversation_prefix_trie": ORACLE_OP12, "op13_perfect_hash_dedup": ORACLE_OP13}
