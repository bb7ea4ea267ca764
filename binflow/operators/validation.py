"""Predicted against true features and masks, and the figures of the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binflow.functions.numeric import pearson
from binflow.functions.scale import TASK_ROWS, exact_quantiles
from binflow.params import KeyNames

KEYS = ["sample_id", "roi_number"]
# Limits and list length used in the report.
HIGH_CORRELATION = 0.9
LOW_R2 = 0.5
NEAR_PERFECT_IOU = 0.95
POOR_IOU = 0.5
SAMPLES_SHOWN = 20


def _joined(pred: DataFrame, gt: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows of both tables side by side (``p_`` and ``g_`` columns), and the common features."""
    shared = [c for c in pred.columns if c in gt.columns and c not in KEYS]
    p = pred.select(*KEYS, *[F.col(c).cast("double").alias(f"p_{c}") for c in shared])
    g = gt.select(*KEYS, *[F.col(c).cast("double").alias(f"g_{c}") for c in shared])
    return p.join(g, KEYS), shared


def match_features(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """(sample_id, roi_number, feature, pred, gt) for features both tables have."""
    wide, shared = _joined(pred, gt)
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(f"p_{c}").alias("pred"), F.col(f"g_{c}").alias("gt")) for c in shared]
    return wide.select(*KEYS, F.inline(F.array(*pairs)))


def _metrics(pred: Column, gt: Column) -> dict[str, Column]:
    """Aggregates over pairs; a pair with a NULL counts nowhere.

    SST is taken from the variance, so one partial aggregation is enough.
    """
    both = pred.isNotNull() & gt.isNotNull()
    p, g = F.when(both, pred), F.when(both, gt)
    error = p - g
    squares = F.avg(error * error)
    return {
        "n": F.count(error),
        "r2": 1 - F.try_divide(squares, F.var_pop(g)),
        "rmse": F.sqrt(squares),
        "mae": F.avg(F.abs(error)),
        "pearson_r": pearson(p, g),
    }


def feature_metrics(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """n, R2 = 1 - SSE/SST, RMSE, MAE and Pearson r per common feature.

    All features are aggregated side by side on the joined rows; only the
    finished figures turn into one row per feature.
    """
    wide, shared = _joined(pred, gt)
    figures = [
        F.struct(F.lit(c).alias("feature"), *[v.alias(k) for k, v in _metrics(F.col(f"p_{c}"), F.col(f"g_{c}")).items()])
        for c in shared
    ]
    return wide.agg(F.array(*figures).alias("_f")).select(F.inline("_f"))


def metrics_of_matched(matched: DataFrame) -> DataFrame:
    """The same figures from rows of :func:`match_features`."""
    figures = _metrics(F.col("pred"), F.col("gt"))
    return matched.groupBy("feature").agg(*[v.alias(k) for k, v in figures.items()])


def feature_summary(metrics: DataFrame) -> DataFrame:
    """One row over all features. ``metrics`` has one row per feature column."""
    stats = [
        f(name).alias(f"{f.__name__.replace('avg', 'mean')}_{name}")
        for name in ("rmse", "mae", "r2", "pearson_r")
        for f in (F.avg, F.median)
    ]
    return metrics.agg(
        F.count(F.lit(1)).alias("total_features"),
        *stats,
        F.count_if(F.col("pearson_r") > HIGH_CORRELATION).alias("features_with_high_correlation"),
        F.count_if(F.col("r2") < LOW_R2).alias("features_with_low_r2"),
    )


def data_coverage(df: DataFrame) -> DataFrame:
    """Rows, distinct samples and the first samples by name as text.

    Only the shown names are gathered; :func:`covered_samples` has them all.
    """
    samples = df.groupBy("sample_id").agg(F.count(F.lit(1)).alias("_rows"))
    totals = samples.agg(F.sum("_rows").alias("num_rows_analyzed"), F.count(F.lit(1)).alias("num_samples_analyzed"))
    shown = samples.select("sample_id").orderBy("sample_id").limit(SAMPLES_SHOWN)
    names = shown.agg(F.array_join(F.array_sort(F.collect_list("sample_id")), ", ").alias("_names"))
    extra = F.col("num_samples_analyzed") - SAMPLES_SHOWN
    rest = F.when(extra > 0, F.concat(F.lit(" ... and "), extra, F.lit(" more"))).otherwise("")
    return totals.select(
        F.coalesce("num_rows_analyzed", F.lit(0)).alias("num_rows_analyzed"),
        "num_samples_analyzed",
        F.concat(names.scalar(), rest).alias("samples"),
    )


def covered_samples(df: DataFrame) -> DataFrame:
    return df.select("sample_id").distinct()


def with_coverage(summary: DataFrame, df: DataFrame) -> DataFrame:
    """The one-row summary with num_rows_analyzed, num_samples_analyzed and samples_analyzed, the sorted sample names.

    Rows shrink to one per sample before the names, which are one JSON array by its definition, come together.
    """
    samples = df.groupBy("sample_id").agg(F.count(F.lit(1)).alias("_rows"))
    covered = samples.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("num_rows_analyzed"),
        F.count("sample_id").alias("num_samples_analyzed"),
        F.array_sort(F.collect_list("sample_id")).alias("samples_analyzed"),
    )
    # One row each.
    return summary.withColumn("_one", F.lit(1)).join(covered.withColumn("_one", F.lit(1)), "_one").drop("_one")


def match_blobs(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """Predicted and true mask arrays of the same particle image."""
    p = pred.select(*KEYS, F.col("mask").alias("pred"))
    g = gt.select(*KEYS, F.col("mask").alias("gt"))
    return p.join(g, KEYS)


def blob_metrics(matched: DataFrame) -> DataFrame:
    """Pixel counts, IoU, Dice, accuracy and differing pixels per particle image.

    Masks stay arrays: one pass over a row, no explode and no shuffle. Two empty
    masks agree, so their IoU and Dice are 1. Where a mask is missing, or the two
    differ in length, every figure is NULL.
    """
    comparable = F.coalesce(F.size("pred") == F.size("gt"), F.lit(False)) & F.col("pred").isNotNull() & F.col("gt").isNotNull()

    def pixels(pred: bool, gt: bool) -> Column:
        zipped = F.zip_with("pred", "gt", lambda p, g: (p.cast("boolean") == F.lit(pred)) & (g.cast("boolean") == F.lit(gt)))
        return F.when(comparable, F.size(F.filter(zipped, lambda hit: hit)))

    counted = matched.select(
        *KEYS,
        pixels(True, True).alias("tp"),
        pixels(True, False).alias("fp"),
        pixels(False, True).alias("fn"),
        pixels(False, False).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counted.select(
        "*",
        F.when(tp.isNotNull(), F.coalesce(F.try_divide(tp, tp + fp + fn), F.lit(1.0))).alias("iou"),
        F.when(tp.isNotNull(), F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(1.0))).alias("dice"),
        F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        (fp + fn).cast("bigint").alias("diff_pixels"),
    )


def blob_summary(metrics: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """One row over all blobs; percentages are NULL when there are none.

    The table is one big group, so its medians come from the spread quantiles.
    """
    rows = metrics.select("iou", "dice", "accuracy", F.lit(1).alias("_all"))
    iou = F.col("iou")
    totals = rows.agg(
        F.count(F.lit(1)).alias("total_blobs"),
        F.avg("iou").alias("mean_iou"),
        F.stddev_pop("iou").alias("std_iou"),
        F.avg("dice").alias("mean_dice"),
        F.avg("accuracy").alias("mean_accuracy"),
        F.count_if(iou == 1).alias("perfect_matches"),
        F.count_if(iou >= NEAR_PERFECT_IOU).alias("near_perfect_matches"),
        F.count_if(iou < POOR_IOU).alias("poor_matches"),
    )
    medians = exact_quantiles(rows, ["_all"], ["iou", "dice"], [0.5], task_rows).select(
        F.struct(F.col("iou_q")[0].alias("iou"), F.col("dice_q")[0].alias("dice"))
    )

    def percent(name: str) -> Column:
        return F.try_divide(100 * F.col(name), F.col("total_blobs")).alias(f"{name}_percent")

    return totals.select(
        "*",
        medians.scalar()["iou"].alias("median_iou"),
        medians.scalar()["dice"].alias("median_dice"),
        *[percent(c) for c in ("perfect_matches", "near_perfect_matches", "poor_matches")],
    )


def pixel_classes(matched: DataFrame) -> DataFrame:
    """One row per pixel: its position and whether it is correct, a false positive or a false negative."""
    p, g = F.col("pixel.pred").cast("boolean"), F.col("pixel.gt").cast("boolean")
    kind = F.when(p == g, "correct").when(p, "false_positive").otherwise("false_negative")
    pixels = matched.select(*KEYS, F.posexplode(F.arrays_zip("pred", "gt")).alias("px", "pixel"))
    return pixels.select(*KEYS, "px", kind.alias("pixel_class"))


def pixel_class_counts(matched: DataFrame) -> DataFrame:
    """Pixels of each class per particle image, without exploding the masks."""
    m = blob_metrics(matched)
    return m.select(
        *KEYS, (F.col("tp") + F.col("tn")).alias("correct"), F.col("fp").alias("false_positive"), F.col("fn").alias("false_negative")
    )


def top_features(metrics: DataFrame, n: int = 10) -> DataFrame:
    return metrics.select("feature", "r2", "rmse", "mae", "pearson_r").orderBy(F.desc_nulls_last("r2"), "feature").limit(n)


def bottom_features(metrics: DataFrame, n: int = 10) -> DataFrame:
    return metrics.select("feature", "r2", "rmse", "mae", "pearson_r").orderBy(F.asc_nulls_last("r2"), "feature").limit(n)


_BLOB_COLUMNS = [*KEYS, "iou", "dice", "accuracy", "diff_pixels"]


def worst_blobs(metrics: DataFrame, n: int = 10) -> DataFrame:
    return metrics.select(*_BLOB_COLUMNS).orderBy(F.asc_nulls_last("iou"), *KEYS).limit(n)


def best_blobs(metrics: DataFrame, n: int = 10) -> DataFrame:
    return metrics.select(*_BLOB_COLUMNS).orderBy(F.desc_nulls_last("iou"), *KEYS).limit(n)


def worst_n_for_display(names: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` comparison names in name order, split at the last ``_iou``.

    The order is by name, not by IoU: see :func:`worst_blobs` for the true ranking.
    """
    parts = r"(?s)^(.*)_iou(.*)$"
    named = F.col("name").rlike(parts)
    return (
        names.select("name")
        .orderBy("name")
        .limit(n)
        .select(
            "name",
            F.when(named, F.regexp_extract("name", parts, 1)).otherwise(F.col("name")).alias("sample_roi"),
            F.when(named, F.regexp_extract("name", parts, 2)).otherwise("unknown").alias("iou_text"),
        )
    )


def report_tables(features: DataFrame, blobs: DataFrame | None = None) -> DataFrame:
    """(section, name, value) of both one-row summaries: 4 places, percentages 1."""

    def tidy(summary: DataFrame, section: str) -> DataFrame:
        def figure(name: str) -> Column:
            return F.round(F.col(name).cast("double"), 1 if name.endswith("_percent") else 4)

        rows = F.array(*[F.struct(F.lit(c).alias("name"), figure(c).alias("value")) for c in summary.columns])
        return summary.select(F.lit(section).alias("section"), F.inline(rows))

    shown = tidy(features, "features")
    return shown if blobs is None else shown.unionByName(tidy(blobs, "blobs"))


def named_keys(pred: DataFrame, gt: DataFrame, names: KeyNames = KeyNames()) -> tuple[DataFrame, DataFrame]:
    """Both tables with the key columns called sample_id and roi_number."""
    return (
        pred.withColumnsRenamed({names.pred_sample: "sample_id", names.pred_roi: "roi_number"}),
        gt.withColumnsRenamed({names.gt_sample: "sample_id", names.gt_roi: "roi_number"}),
    )
