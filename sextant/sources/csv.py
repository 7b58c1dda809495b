"""Utterance CSV sources.

The labelled CSVs have a header row, doubled inner quotes and differing
column orders, so columns are always bound by *name*.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions.text import strip_suffix

UTTERANCE_COLUMNS = ("id", "text", "intent")
#: Columns that a file of a folder may have; one with more fails instead of losing some.
MAX_COLUMNS = 64
_POS = tuple(f"c{k}" for k in range(MAX_COLUMNS))
RAW_SCHEMA = ", ".join(f"{c} string" for c in (*_POS, "too_many"))


def _reader(spark: SparkSession):
    return (spark.read.option("header", True).option("escape", '"')
            .option("multiLine", True).option("mode", "FAILFAST"))


def normalise_truth_column(df: DataFrame) -> DataFrame:
    """A truth column called ``label`` becomes ``intent`` (no-op otherwise)."""
    if "label" in df.columns and "intent" not in df.columns:
        return df.withColumnRenamed("label", "intent")
    return df


def read_utterances(spark: SparkSession, path: str) -> DataFrame:
    """One utterance CSV as ``(id LONG, text STRING, intent STRING)``.

    The literal intent ``None`` stays the string ``None``.
    """
    df = normalise_truth_column(_reader(spark).csv(path))
    return df.select(F.col("id").cast("long").alias("id"), F.col("text"), F.col("intent"))


def bind_by_header(raw: DataFrame) -> DataFrame:
    """Positional strings + ``file_name``, ``file_path`` -> ``(dataset, id, text, intent)`` by header names.

    Each file's header row is the row holding the three column names
    (a data row cannot: its ``id`` is an integer); an empty cell makes no row
    a header.  Where the three names stand is joined back onto the other rows
    of the same file, by its whole path, so files may have any order and
    other columns besides.  ``label`` is accepted for ``intent`` (P2).
    """
    cells = F.array(*[F.col(c) for c in _POS])
    at = {n: F.array_position(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in _POS]), n) for n in ("id", "text", "intent", "label")}
    truth = F.when(at["intent"] > 0, at["intent"]).otherwise(at["label"])
    full = F.when(F.col("too_many").isNotNull(), F.raise_error(F.concat(
        F.lit(f"more than {MAX_COLUMNS} columns in "), "file_path"))).otherwise(cells)
    found = raw.select("file_name", "file_path", full.alias("cells"), at["id"].alias("a"), at["text"].alias("b"), truth.alias("c"))
    is_header = (F.col("a") > 0) & (F.col("b") > 0) & (F.col("c") > 0)
    header = found.where(is_header).select("file_path", "a", "b", "c")
    body = found.where(~is_header).drop("a", "b", "c").join(header, "file_path")

    def pick(place):
        return F.element_at("cells", F.col(place).cast("int"))

    return body.select(strip_suffix("file_name").alias("dataset"), pick("a").cast("long").alias("id"),
                       pick("b").alias("text"), pick("c").alias("intent"))


def raw_rows(reader, directory: str, exclude: str | None = None, multi_line: bool = True) -> DataFrame:
    """Rows of all ``*.csv`` of a folder as positional strings; shorter rows end in nulls.

    ``multi_line`` off lets Spark split large files; it asks for texts without line breaks.
    """
    raw = (reader.schema(RAW_SCHEMA).option("header", False).option("escape", '"')
           .option("multiLine", multi_line).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.csv")
           .csv(directory).select("*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("file_path")))
    return raw.where(~F.col("file_name").contains(exclude)) if exclude else raw


def read_dataset_dir(spark: SparkSession, directory: str, exclude: str | None = None, multi_line: bool = True) -> DataFrame:
    """Every ``*.csv`` of a folder, with ``dataset`` = file name minus ``.csv``.

    All files are read in one scan as positional strings; the dataset name
    comes from the file metadata column, ``exclude`` drops names that
    contain it (S3), and each file's own header binds its columns by name
    (:func:`bind_by_header`), since column order differs between files.
    """
    return bind_by_header(raw_rows(spark.read, directory, exclude, multi_line)).select("id", "text", "intent", "dataset")


def read_stage_csv(spark: SparkSession, path: str) -> DataFrame:
    """A stage result written with a leading unnamed index column -> ``id``."""
    df = _reader(spark).csv(path)
    first = df.columns[0]
    if first in ("", "_c0"):
        df = df.withColumnRenamed(first, "id").withColumn("id", F.col("id").cast("long"))
    return normalise_truth_column(df)


def write_stage_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a stage result as CSV with header (directories are created)."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
