"""From raw documents to packed training sequences: five stages, each one operator of sextant.llm.

Every stage takes the documents that the one before it kept, written as
Parquet and read again, and (but for the last) returns rows with the columns
of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm import quality
from sextant.llm.common import stored, table
from sextant.llm.decontamination import contamination
from sextant.llm.jaccard import MEMBER_ROWS, jaccard_components
from sextant.llm.packing import best_fit_pack
from sextant.llm.phrases import remove_repeated_windows
from sextant.session import bounded_broadcast, ensure_checkpoint_dir


#: Bytes of a batch that goes to a Python worker; batches cut by rows alone are large where texts are long.
ARROW_BYTES = 4 << 20


def _narrow(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, rest)``: all other columns in one, so that none clashes with what an operator adds."""
    rest = [F.col(f"`{c}`").alias(f"r{k}") for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest, F.lit(0).alias("none")).alias("rest"))


def _widen(found: DataFrame, docs: DataFrame, n_chars=None) -> DataFrame:
    """The columns of ``docs`` again; ``n_chars`` gives that column new values."""
    def column(k: int, c: str):
        if c == "n_chars" and n_chars is not None:
            return n_chars(F.col(f"rest.r{k}")).cast(docs.schema[c].dataType).alias(c)
        return F.col(c) if c in ("doc_id", "text") else F.col(f"rest.r{k}").alias(c)
    return found.select(*[column(k, c) for k, c in enumerate(docs.columns)])


KEYS = ["k0", "k1"]


def _keyed(docs: DataFrame) -> DataFrame:
    """``(row, k0, k1, text)``: all columns in one, and the id and a hash of the text, which tell documents apart."""
    cells = [F.col(f"`{c}`").alias(f"r{k}") for k, c in enumerate(docs.columns)]
    return docs.select(F.struct(*cells).alias("row"), F.col("doc_id").alias("k0"), F.xxhash64("text").alias("k1"), "text")


def _unpacked(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*[F.col(f"row.r{k}").alias(c) for k, c in enumerate(docs.columns)])


def _by_key(left: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of ``left`` whose keys are, or are not, in ``keys``; while these are few, texts stay where they are."""
    keys = bounded_broadcast(keys.select(F.col("k0").alias("g0"), F.col("k1").alias("g1")).distinct(), MEMBER_ROWS)
    return left.join(keys, F.col("k0").eqNullSafe(F.col("g0")) & (F.col("k1") == F.col("g1")), how)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier takes for good; those with a score under 0.7 go.

    Null and empty texts have the score of a text without features and share
    its decision; repeated rows have the same score, so all of them stay or
    go; rows without an id are judged like others.  Texts of any length are
    scored whole, and only keys come back from the scorer.  An empty table
    stays empty; columns of any name pass through.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    keyed = _keyed(docs)
    judged = quality.score(keyed.select("text", *KEYS), model, threshold=0.7, id_col="k0", keep=KEYS)
    return _unpacked(_by_key(keyed.select("row", *KEYS), stored(judged.where("predicted = 0").select(*KEYS), "rejected"), "left_anti"), docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity 0.8).

    It is the one of the smallest id, of several texts of that id the one of
    the least hash; documents without an id come after all others.  Of rows
    with the same id and text one stays.  Documents without words (null,
    empty, white space) are no copies of each other and stay.  Texts of any
    length count whole.  An empty table stays empty; columns of any name pass
    through.
    """
    keyed = _keyed(docs)
    found = jaccard_components(keyed.select("text", *KEYS), n=5, num=80, den=100, id_col="k0", keep=KEYS, group_col="group").where("n_shingles > 0")
    found = found.select(*KEYS, "group")
    place = F.struct(F.col("k0").isNull().alias("none"), *KEYS)
    firsts = found.groupBy("group").agg(F.min(place).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    judged = found.join(bounded_broadcast(firsts, MEMBER_ROWS), "group").withColumn("stays", place == F.col("first"))
    twice = judged.where("stays").groupBy(*KEYS).count().where("count > 1")
    left = _by_key(keyed.select("row", *KEYS), judged.where(~F.col("stays")), "left_anti")
    once = _by_key(left, twice, "left_semi").dropDuplicates(KEYS)
    return _unpacked(_by_key(left, twice, "left_anti").unionByName(once), docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 35 words and more that recur; documents of nothing else go.

    Repeated rows lose what they share, all of them, so rows that are equal
    in 35 words and more go together; null texts stay null, empty ones empty,
    rows without an id are treated like others.  Texts of any length count
    whole.  An empty table stays empty; columns of any name pass through,
    ``n_chars`` with the new length where words went.
    """
    found = remove_repeated_windows(_narrow(docs), window=35, keep=["doc_id", "rest"], with_text=True)
    left = found.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words"))).withColumnRenamed("kept_text", "text")
    return _widen(left, docs, lambda old: F.when(F.col("n_removed") > 0, F.length("text")).otherwise(old))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any 10 consecutive words of a benchmark item, or all words of a shorter item.

    Null and empty texts hold no words and stay; repeated rows stay or go
    together; rows without an id are treated like others.  Texts of any
    length count whole.  An empty table, or an empty benchmark, leaves the
    documents as they are; columns of any name pass through.
    """
    keyed = _keyed(docs)
    found = contamination(keyed.select("text", *KEYS), table(spark, sf_dir, "benchmark"), n=10, id_col="k0", keep=KEYS)
    return _unpacked(_by_key(keyed.select("row", *KEYS), found.where("contaminated"), "left_anti"), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, packed into sequences of 1024 tokens.

    Null and empty texts are a piece of their end token alone; repeated rows
    and rows without an id are packed each for itself; texts of any length
    are encoded whole and cut.  An empty table has no pieces.
    """
    return best_fit_pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2, give_up=True)


STAGES = [("quality_classifier", quality_classifier), ("ngram_jaccard_join", ngram_jaccard_join), ("substring_dedup", substring_dedup),
          ("benchmark_decontamination", benchmark_decontamination), ("best_fit_packing", best_fit_packing)]

#: A trained classifier and a tokenizer are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written into the shared checkpoint folder and read again."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{folder}/{k}-{name}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
