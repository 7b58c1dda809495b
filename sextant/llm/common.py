"""What the operators of this folder share: tables, shared-folder tables, bounded sampling."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from sextant.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the session's shared checkpoint folder and read it back.

    Cuts the lineage, and every executor (also one that starts later) can read it.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/sextant-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(id_col: Column) -> Column:
    """True for the fold that no model may learn from; a null id is in no fold, so not held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def byte_groups(texts: list, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of consecutive texts with at most ``limit`` bytes or one text each."""
    i, size = 0, 0
    for j, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if j > i and size + n > limit:
            yield i, j
            i, size = j, 0
        size += n
    if i < len(texts):
        yield i, len(texts)


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` has at most ``limit`` bytes in each, or one row.

    Arrow batches are cut by rows, so those of long texts are large; what a
    function makes of a batch stays small this way.  Memory that the worker
    no longer needs goes back to the machine at the end.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(ends, limit + (ends[at - 1] if at else 0), side="right")))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


def as_bytes(column: pa.Array) -> list:
    """Values of a string column as UTF-8 bytes, None for null, without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def unit_hash(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns' values only."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / float(1 << 30)


def result_schema(docs: DataFrame, names: dict[str, str], more: str) -> StructType:
    """Columns of ``docs`` under new names (new: old), then those of the DDL string ``more``."""
    return StructType([*(StructField(new, docs.schema[old].dataType) for new, old in names.items()), *StructType.fromDDL(more)])
