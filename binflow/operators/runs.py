"""Planning, running and reporting of resumable file runs."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binflow.functions.scale import number_rows

STATUS_SCHEMA = "path string, ok boolean, error string"


def contiguous_chunks(files: DataFrame, workers: int) -> DataFrame:
    """Adds ``chunk``: runs of ceil(files / workers) files in path order.

    Later chunks may be short or empty; this is not ``ntile``. There are never
    more chunks than files.
    """
    numbered = number_rows(files, ["path"])
    count = numbered.agg(F.max("rn")).scalar()
    size = F.ceil(count / F.least(F.lit(max(workers, 1)), count))
    return numbered.withColumn("chunk", F.floor((F.col("rn") - 1) / size)).drop("rn")


def batches(chunked: DataFrame, size: int = 1000) -> DataFrame:
    """Adds ``batch``, counted from 0 inside each chunk, in path order."""
    numbered = number_rows(chunked, ["path"], ["chunk"])
    return numbered.withColumn("batch", F.floor((F.col("rn") - 1) / max(size, 1))).drop("rn")


def run_batches(
    plan: DataFrame,
    process: Callable[[list[str]], None],
    stage: Callable[[str], str] | None = None,
) -> DataFrame:
    """(path, ok, error) after calling ``process`` on the files of each batch.

    ``stage`` turns a path into the source to process; a file it fails on is an
    error and is not tried. A batch that fails as a whole is retried file by
    file. A batch holds at most the planned number of files, so a group is
    bounded. Tasks may run twice, so ``process`` must overwrite its outputs.
    """

    def attempt(paths: list[str]) -> str | None:
        try:
            process(paths)
        except Exception as problem:  # any failure of the caller's function is a result here
            return str(problem) or type(problem).__name__
        return None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        errors: dict[str, str | None] = {}
        sources: dict[str, str] = {}
        for path in pdf["path"].sort_values():
            try:
                sources[path] = stage(path) if stage else path
            except Exception as problem:
                errors[path] = str(problem) or type(problem).__name__
        if sources:
            if attempt(list(sources.values())) is None:
                errors.update(dict.fromkeys(sources))
            else:
                errors.update({path: attempt([source]) for path, source in sources.items()})
        return pd.DataFrame(
            {"path": list(errors), "ok": [e is None for e in errors.values()], "error": list(errors.values())}
        )

    # A set number of partitions: rows are only paths, so small bytes must not mean one task.
    parts = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = plan.select("chunk", "batch", "path").repartition(parts, "chunk", "batch")
    return laid.groupBy("chunk", "batch").applyInPandas(run, STATUS_SCHEMA)


def run_summary(status: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Units, successes, failures and the verdict under two policies.

    An archive run fails only if every unit failed; an inference run fails on any
    failure, or if nothing succeeded although there was work.
    """
    ok, failed = F.count_if("ok"), F.count_if(~F.col("ok"))
    total = F.count(F.lit(1))
    return status.groupBy(*(by or [])).agg(
        total.alias("total"),
        ok.alias("succeeded"),
        failed.alias("failed"),
        ((failed > 0) & (ok == 0)).alias("archive_run_failed"),
        ((failed > 0) | ((ok == 0) & (total > 0))).alias("inference_run_failed"),
    )


def failed_units(status: DataFrame) -> DataFrame:
    """The failed units as rows; the list may be long, so it is not gathered."""
    return status.filter(~F.col("ok"))


def run_progress(status: DataFrame, every: int = 10) -> DataFrame:
    """Progress at every n-th finished unit of each run.

    The rate counts from the first finish of the run. A run may hold most of the
    rows: its units are numbered across partitions, and only every n-th row
    meets the totals of its run.
    """
    totals = status.groupBy("run_id").agg(F.count(F.lit(1)).alias("total"), F.min("finished_at").alias("_start"))
    numbered = number_rows(status.select("run_id", "unit_id", "finished_at"), ["finished_at", "unit_id"], ["run_id"], "processed")
    shown = numbered.filter(F.col("processed") % every == 0).join(totals, "run_id")
    seconds = F.timestamp_diff("MICROSECOND", "_start", "finished_at") / 1e6
    rate = F.coalesce(F.try_divide(F.col("processed").cast("double"), seconds), F.lit(0.0))
    left = F.col("total") - F.col("processed")
    return shown.select(
        "run_id",
        "processed",
        "total",
        (100.0 * F.col("processed") / F.col("total")).alias("percent"),
        rate.alias("units_per_second"),
        F.coalesce(F.try_divide(left.cast("double"), rate), F.lit(0.0)).alias("eta_seconds"),
    )


def skip_reasons(validated: DataFrame) -> DataFrame:
    reason = F.when(F.col("valid"), "valid").otherwise(F.col("reason"))
    return validated.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("files"))
