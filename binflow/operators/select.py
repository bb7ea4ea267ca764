"""Restrictions and projections on bins, files and detections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binflow.functions import text


def filter_bin_type(bins: DataFrame, bin_type: str) -> DataFrame:
    """Bins whose identifier starts with the type letter, case-sensitive."""
    return bins.filter(F.col("bin_id").startswith(bin_type))


def select_units(df: DataFrame, ids: DataFrame | list[str] | None = None, key: str = "bin_id") -> DataFrame:
    """Keep the listed units; None or an empty list keeps all.

    The list joins by semi-join: its size decides at run time between a
    broadcast and a shuffle, and repeated ids do not repeat rows.
    """
    if ids is None or (isinstance(ids, list) and not ids):
        return df
    if isinstance(ids, list):
        ids = df.sparkSession.createDataFrame([(i,) for i in ids], f"{key} string")
    elif ids.isEmpty():
        return df
    return df.join(ids.select(key), key, "left_semi")


def training_ids(bins: DataFrame, ids: DataFrame | None, bin_type: str) -> DataFrame:
    """Identifiers to train on: the explicit list as it is, else all bins of the type."""
    if ids is not None:
        return ids.select("bin_id")
    found = filter_bin_type(bins, bin_type).select("bin_id")
    if found.isEmpty():
        raise ValueError(f"no {bin_type} bins found")
    return found


def parse_pid(bins: DataFrame, column: str = "bin_id") -> DataFrame:
    """Adds acquired_at, instrument and day."""
    return bins.select("*", *text.pid_fields(F.col(column)))


def count_bins_by_type(bins: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Bins of type I and D, per data set when ``by`` names its columns."""
    kind = F.substring("bin_id", 1, 1)
    return (
        bins.filter(kind.isin("I", "D"))
        .groupBy(*(by or []), kind.alias("bin_type"))
        .agg(F.count(F.lit(1)).alias("bins"))
    )


def pending(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose exact path is not in the manifest."""
    return files.join(manifest.select("path"), "path", "left_anti")


def pending_counts(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """How many files are complete and how many are still to do."""
    done = manifest.select("path").distinct().withColumn("_done", F.lit(True))
    marked = files.select("path").join(done, "path", "left")
    return marked.agg(
        F.count(F.lit(1)).alias("found"),
        F.count("_done").alias("complete"),
        F.count_if(F.col("_done").isNull()).alias("to_do"),
    )


def missing_inputs(listed: DataFrame, existing: DataFrame, key: str = "path") -> DataFrame:
    """Listed inputs that do not exist, each once."""
    return listed.select(key).distinct().join(existing.select(key), key, "left_anti")
