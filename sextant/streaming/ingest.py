"""Incremental ingest: the stage precompute (entry 3) over utterance CSVs as they arrive.

The original reads every ``*.csv`` of a folder (S2) and precomputes the
candidate stage per dataset.  Here the folder is a Structured Streaming file
source: each micro-batch holds the rows of newly arrived files, and
``foreachBatch`` runs the batch operators on them and writes the results
under the batch's number, partitioned by dataset; a batch that is run again
replaces what it wrote.  The checkpoint location makes restarts skip files
already processed (the "reuse if present" rule of S10, per file).

A streaming CSV source needs one fixed schema, but the datasets order their
columns differently; so rows are read as positional strings with the
header row kept, and each file's header row is joined back to bind the
columns by name (``sources.csv.bind_by_header``) - distributed, per file,
no driver-side inspection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.operators.candidates import extract
from sextant.sources.csv import bind_by_header, raw_rows

def read_stream(spark: SparkSession, in_dir: str, exclude: str | None = None) -> DataFrame:
    """S2 as a stream: every new ``*.csv`` in ``in_dir`` (names containing ``exclude`` skipped)."""
    return raw_rows(spark.readStream, in_dir, exclude)


def start_candidate_stream(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
                           method: str = "action-object-ext", available_now: bool = True,
                           exclude: str | None = "demo"):
    """Start the incremental candidate stage; returns the ``StreamingQuery``.

    With ``available_now`` the query processes every file present and stops
    (a restartable batch); otherwise it keeps watching the folder.
    """
    def batch(df: DataFrame, epoch_id: int) -> None:
        rows = bind_by_header(df)
        out = extract(rows, method, id_col=["dataset", "id"]).select("dataset", "id", "text", "intent", "candidate_intent")
        (out.withColumn("epoch", F.lit(epoch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("epoch", "dataset").parquet(out_dir))

    writer = read_stream(spark, in_dir, exclude).writeStream.foreachBatch(batch).option(
        "checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
