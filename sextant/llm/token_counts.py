"""Token counts: batch encoding inside Arrow functions that return lengths only.

Each Arrow batch is dealt into groups of texts of about ``batch_bytes`` so
that the encoder's working set does not depend on how long the texts are.
Long texts are cut at boundaries that no token can span (``tokenizing``), and
only the numbers of tokens leave the worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import by_bytes, byte_groups
from sextant.llm.tokenizing import length_encoder


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 4096, id_col: str = "doc_id",
                 text_col: str = "text", batch_bytes: int = 1 << 20) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` per row, in any order, without begin or end tokens.

    ``tokenizer_path`` names a .model (sentencepiece) or .json (tokenizers)
    file that exists on every executor.  A null or empty text has 0 bytes and
    0 tokens; repeated rows and null ids are counted row by row; an empty
    table gives an empty result; other columns, whatever their names, are not
    read.  A text of any length is counted whole.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = length_encoder(tokenizer_path)
        for batch in by_bytes(batches, "text"):
            texts, lengths = [t or "" for t in batch.column(2).to_pylist()], []
            for i, j in byte_groups(texts, batch_bytes):
                lengths += encoder.lengths(texts[i:j])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths, pa.int64())],
                                             ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
                       F.col(text_col).alias("text"))
    counted = rows.mapInArrow(count, f"id {id_type}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
