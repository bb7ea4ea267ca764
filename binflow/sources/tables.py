"""Feature tables of the validation, and one-object JSON summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from binflow.operators.select import select_units
from binflow.operators.validation import named_keys
from binflow.params import KeyNames

# Keys of the summary object; any may be absent.
SUMMARY_SCHEMA = (
    "total_features bigint, mean_rmse double, median_rmse double, mean_mae double, median_mae double, "
    "mean_r2 double, median_r2 double, mean_pearson_r double, median_pearson_r double, "
    "features_with_high_correlation bigint, features_with_low_r2 bigint, "
    "num_rows_analyzed bigint, num_samples_analyzed bigint, samples_analyzed array<string>"
)


def read_feature_tables(
    pred: DataFrame, gt: DataFrame, names: KeyNames = KeyNames(), sample_ids: DataFrame | list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Both tables with common key names, cut to the wanted samples if any are named.

    Pass ``spark.table``, ``spark.read.parquet`` or a JDBC reader's DataFrame.
    """
    p, g = named_keys(pred, gt, names)
    if isinstance(sample_ids, DataFrame):
        sample_ids = sample_ids.select("sample_id").distinct()
    return select_units(p, sample_ids, "sample_id"), select_units(g, sample_ids, "sample_id")


def export_summary_json(summary: DataFrame, path: str) -> None:
    """Write a one-row summary as one JSON object."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def read_summary_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUMMARY_SCHEMA).option("multiLine", True).json(path)
