"""Session construction, checkpointing and size-checked broadcast.

Everything here is plain Spark configuration.  On a cluster the session is
built by the platform; the library only *reads* ``spark.checkpoint.dir`` and
sets its own folder when none is configured and the master is local (tests).
"""

from __future__ import annotations

import os
import tempfile
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest number of rows we ever broadcast without having counted them:
# tables whose size is fixed by construction (option lists, parameter grids,
# K centroids after a count check) stay far below it.
BROADCAST_ROW_LIMIT = 200_000
#: Bytes; what Catalyst takes a table to have whose size it does not know.
LARGEST_ESTIMATE = (1 << 63) - 1
#: Whether a query's shuffle files go when it ends, not when the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_steps = threading.local()


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "sextant") -> SparkSession:
    """Build (or fetch) a session with the settings the operators assume."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    builder = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.ansi.enabled", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send the package's Python files to the workers, which need not have it on their path.

    Workers of a session that another tool built need the package installed
    (``pip install .``) or this call.
    """
    import atexit
    import shutil
    import zipfile
    from pathlib import Path

    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="sextant-py-")  # the driver serves it for as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = os.path.join(folder, f"sextant-{os.getpid()}.zip")
    with zipfile.ZipFile(name, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, os.path.join("sextant", path.relative_to(root)))
    spark.sparkContext.addPyFile(name)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, reading it from the session.

    A cluster must name a shared folder in ``spark.checkpoint.dir``.  Only a
    local master (tests, benchmarks) may fall back to a private temp folder.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="sextant-ckpt-")
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the session's checkpoint folder.

    Survives executor loss and truncates iterative plans.  The shuffle files of what was computed
    for it go at once.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        kept = df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    kept = _plain_estimate(kept)
    if getattr(_steps, "made", None) is not None:
        _steps.made.append(kept)
    return kept


def drop_checkpoint(kept: DataFrame) -> None:
    """Delete the files of what :func:`cut_lineage` returned; nothing that reads it may be left to compute."""
    spark = kept.sparkSession
    file = kept._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_steps(make: Callable[[], DataFrame]) -> DataFrame:
    """``cut_lineage(make())``; the checkpoints that were made on the way are deleted then."""
    outer, _steps.made = getattr(_steps, "made", None), []
    try:
        df = make()
        on_the_way, _steps.made = _steps.made, outer
        kept = cut_lineage(df)
    finally:
        _steps.made = outer
    for step in on_the_way:
        drop_checkpoint(step)
    return kept


def _plain_estimate(kept: DataFrame) -> DataFrame:
    """A checkpoint without its plan's estimate of bytes, where that is beyond any table.

    Catalyst takes a join to be as large as the product of its sides, and a checkpoint keeps the
    estimate.  In iterations that join what they kept before, the number's digits double from
    round to round, until these numbers alone fill the driver.
    """
    plan = kept._jdf.queryExecution().logical()
    try:
        if plan.stats().sizeInBytes() <= LARGEST_ESTIMATE:
            return kept
    except ValueError:  # more digits than Python reads
        pass
    session, jvm = kept.sparkSession, kept.sparkSession._jvm
    none = jvm.scala.Option.apply(None)
    fresh = jvm.org.apache.spark.sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(),
                                                          plan.isStreaming(), plan.stream(), session._jsparkSession, none, none)
    return type(kept)(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, fresh), session)


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy row work at least one partition per core.

    A small file is one scan partition; on a cluster, inputs already have
    many splits and this is a no-op.  Use on scans only (no shuffle below).
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df


def bounded_broadcast(small: DataFrame, max_rows: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast ``small`` only after proving its row count is below ``max_rows``.

    Beyond the bound the table is returned unhinted, so the join falls back to
    a shuffle join (AQE may still broadcast it from runtime statistics).
    """
    n = small.limit(max_rows + 1).count()
    return F.broadcast(small) if n <= max_rows else small
