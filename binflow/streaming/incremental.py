"""Incremental runs over a growing folder of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from binflow.operators.runs import batches, run_batches
from binflow.session import materialize
from binflow.sources.manifest import BUCKETS, Ledger

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """New files below ``root`` as (path, size); contents are not read."""
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
    found = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return found.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("size"))


def attempt(
    files: DataFrame,
    ledger: Ledger,
    process: Callable[[list[str]], None],
    run_id: str,
    stage: Callable[[str], str] | None = None,
    batch_size: int = 1000,
) -> DataFrame:
    """Process those of the files (path) that are not finished, note the outcome in the ledger, and return it.

    Files that another attempt has finished meanwhile are left out, and each file is tried once.
    """
    todo = ledger.pending(files.select("path").distinct()).withColumn("chunk", F.lit(0))
    status = materialize(run_batches(batches(todo, batch_size), process, stage))
    ledger.append(status, run_id)
    return status


def incremental_bins(
    files: DataFrame,
    process: Callable[[list[str]], None],
    status_path: str,
    checkpoint: str,
    stage: Callable[[str], str] | None = None,
    batch_size: int = 1000,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Process the files that arrived since the last run, then stop.

    Outcomes go to the ledger at ``status_path``. A micro-batch repeated after a crash tries only the files that are
    not finished there, so it touches the buckets of its own files and reads no history of others into a shuffle. Failed
    files are worked off by :func:`run_incremental`, as a file source never offers a file twice.
    """

    def handle(arrived: DataFrame, batch_id: int) -> None:
        attempt(arrived, Ledger(arrived.sparkSession, status_path, buckets), process, f"batch-{batch_id}", stage, batch_size)

    return (
        files.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_incremental(
    files: DataFrame,
    process: Callable[[list[str]], None],
    status_path: str,
    checkpoint: str,
    stage: Callable[[str], str] | None = None,
    batch_size: int = 1000,
    buckets: int = BUCKETS,
) -> DataFrame:
    """One run: the files that failed before, then those that arrived; returns the state of every file so far.

    What is pending is worked out anew in each run, whether files have arrived or not. A file that fails in this run is pending
    for the next one.
    """
    spark = files.sparkSession
    ledger = Ledger(spark, status_path, buckets)
    failed = ledger.failed().select("path") if ledger.exists else None
    if failed is not None and not failed.isEmpty():
        attempt(failed, ledger, process, "retry", stage, batch_size)
    incremental_bins(files, process, status_path, checkpoint, stage, batch_size, buckets).awaitTermination()
    return Ledger(spark, status_path, buckets).latest()
