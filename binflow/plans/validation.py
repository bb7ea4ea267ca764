"""Predicted against true features and masks: metrics, summaries and the report, written task by task."""

from __future__ import annotations

from pyspark.sql import DataFrame

from binflow.operators import validation as ops
from binflow.operators.select import select_units
from binflow.params import KeyNames
from binflow.plans.flow import FlowRun
from binflow.sources.tables import export_summary_json, read_feature_tables, read_summary_json


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").option("header", True).csv(path)
    return df.sparkSession.read.schema(df.schema).option("header", True).csv(path)


def validate_run(
    flow: FlowRun,
    out: str,
    pred: DataFrame,
    gt: DataFrame,
    names: KeyNames = KeyNames(),
    sample_ids: DataFrame | list[str] | None = None,
    masks: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Validate features, compare masks if there are any, and report; returns the rows of the report.

    Writes below ``out``: ``feature_metrics`` (CSV), ``summary`` (one JSON object, with coverage), ``blob_metrics`` (CSV) and
    ``report`` (CSV). Each task reads what the one before wrote, so a report agrees with the files beside it. ``sample_ids`` (None or
    empty: all) restricts features and masks alike. Without masks the report has no section on them.
    """
    spark = flow.spark

    def features() -> DataFrame:
        p, g = read_feature_tables(pred, gt, names, sample_ids)
        metrics = _stored(ops.feature_metrics(p, g), f"{out}/feature_metrics")
        analyzed = p.select(*ops.KEYS).join(g.select(*ops.KEYS), ops.KEYS)
        export_summary_json(ops.with_coverage(ops.feature_summary(metrics), analyzed), f"{out}/summary")
        return read_summary_json(spark, f"{out}/summary").drop("num_rows_analyzed", "num_samples_analyzed", "samples_analyzed")

    def blobs() -> DataFrame:
        p, g = (select_units(m, sample_ids, "sample_id") for m in masks)
        return ops.blob_summary(_stored(ops.blob_metrics(ops.match_blobs(p, g)), f"{out}/blob_metrics"))

    summary = flow.task("feature_validation", features)
    compared = flow.task("blob_comparison", blobs) if masks is not None else None
    return flow.task("validation_report", lambda: _stored(ops.report_tables(summary, compared), f"{out}/report"))
