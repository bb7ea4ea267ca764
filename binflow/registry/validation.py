"""Feature and mask validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from binflow.bindings import load
from binflow.operators import validation as ops
from binflow.plans.flow import FlowRun
from binflow.plans.validation import validate_run
from binflow.registry import query
from binflow.registry.rounding import places_of, rounded
from binflow.session import scratch_path
from binflow.sources import tables

_FEATURES = ("area", "biovolume", "solidity", "eccentricity")
_MATCH_SQL = "wide as (select p.sample_id, p.roi_number, " + ", ".join(
    f"p.{c} as p_{c}, g.{c} as g_{c}" for c in _FEATURES
) + """ from {pred_features} p join {gt_features} g on p.sample_id = g.ifcb_bin and p.roi_number = g.roi_number),
    matched as (""" + " union all ".join(
    f"select sample_id, roi_number, '{c}' as feature, p_{c} as pred, g_{c} as gt from wide" for c in _FEATURES
) + ")"
_METRICS_SQL = _MATCH_SQL + """,
    metrics as (select feature, count(*) as n, 1 - sum((pred-gt)*(pred-gt)) / nullif(var_pop(gt) * count(*), 0) as r2,
                       sqrt(avg((pred-gt)*(pred-gt))) as rmse, avg(abs(pred-gt)) as mae,
                       covar_pop(pred, gt) / nullif(stddev_pop(pred) * stddev_pop(gt), 0) as pearson_r
                from matched group by feature)"""
_SUMMARY_COLUMNS = """count(*) as total_features,
    avg(rmse) as mean_rmse, median(rmse) as median_rmse, avg(mae) as mean_mae, median(mae) as median_mae,
    avg(r2) as mean_r2, median(r2) as median_r2, avg(pearson_r) as mean_pearson_r, median(pearson_r) as median_pearson_r,
    count(*) filter (pearson_r > 0.9) as features_with_high_correlation, count(*) filter (r2 < 0.5) as features_with_low_r2"""
_PIXELS_SQL = """pixels as (select p.sample_id, p.roi_number, unnest(p.mask) as pred, unnest(g.mask) as gt,
        unnest(range(0, len(p.mask)))::int as px
        from {pred_masks} p join {gt_masks} g on p.sample_id = g.sample_id and p.roi_number = g.roi_number)"""
_BLOBS_SQL = _PIXELS_SQL + """,
    counts as (select sample_id, roi_number, count(*) filter (pred = 1 and gt = 1)::int as tp, count(*) filter (pred = 1 and gt = 0)::int as fp,
                      count(*) filter (pred = 0 and gt = 1)::int as fn, count(*) filter (pred = 0 and gt = 0)::int as tn
               from pixels group by sample_id, roi_number),
    blobs as (select *, case when tp + fp + fn = 0 then 1e0 else tp::double / (tp + fp + fn) end as iou,
                     case when tp + fp + fn = 0 then 1e0 else 2 * tp::double / (2 * tp + fp + fn) end as dice,
                     (tp + tn)::double / (tp + fp + fn + tn) as accuracy, (fp + fn)::bigint as diff_pixels from counts)"""
_BLOB_SUMMARY_COLUMNS = """count(*) as total_blobs, avg(iou) as mean_iou, median(iou) as median_iou, stddev_pop(iou) as std_iou,
    avg(dice) as mean_dice, median(dice) as median_dice, avg(accuracy) as mean_accuracy,
    count(*) filter (iou = 1) as perfect_matches, count(*) filter (iou >= 0.95) as near_perfect_matches,
    count(*) filter (iou < 0.5) as poor_matches,
    100e0 * count(*) filter (iou = 1) / count(*) as perfect_matches_percent,
    100e0 * count(*) filter (iou >= 0.95) / count(*) as near_perfect_matches_percent,
    100e0 * count(*) filter (iou < 0.5) / count(*) as poor_matches_percent"""
_MEANS = ("mean_rmse", "median_rmse", "mean_mae", "median_mae", "mean_r2", "median_r2", "mean_pearson_r", "median_pearson_r")
_BLOB_MEANS = ("mean_iou", "median_iou", "std_iou", "mean_dice", "median_dice", "mean_accuracy",
               "perfect_matches_percent", "near_perfect_matches_percent", "poor_matches_percent")


def _round_sql(names: tuple[str, ...], places: int = 6) -> str:
    return ", ".join(f"round({c}, {places_of(c, places)}) as {c}" for c in names)


def _tables(spark, sf, sample_ids=None):
    pred, gt = load(spark, sf, "pred_features"), load(spark, sf, "gt_features")
    return tables.read_feature_tables(pred, gt, sample_ids=sample_ids)


def _matched(spark, sf):
    return ops.match_features(*_tables(spark, sf))


def _metrics(spark, sf):
    return ops.feature_metrics(*_tables(spark, sf))


def _masks(spark, sf):
    return ops.match_blobs(load(spark, sf, "pred_masks"), load(spark, sf, "gt_masks"))


def _blobs(spark, sf):
    return ops.blob_metrics(_masks(spark, sf))


@query(
    "read_feature_tables",
    f"""select 'pred' as side, sample_id, roi_number, {_round_sql(_FEATURES)} from {{pred_features}}
        where sample_id in (select concat('S', lpad(s_suppkey::varchar, 6, '0')) from {{supplier}} where s_nationkey < 5)
        union all select 'gt', ifcb_bin, roi_number, {_round_sql(_FEATURES)} from {{gt_features}}
        where ifcb_bin in (select concat('S', lpad(s_suppkey::varchar, 6, '0')) from {{supplier}} where s_nationkey < 5)""",
)
def read_feature_tables(spark, sf):
    wanted = load(spark, sf, "supplier").filter("s_nationkey < 5")
    sample = F.concat(F.lit("S"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0"))
    pred, gt = _tables(spark, sf, wanted.select(sample.alias("sample_id")))
    both = pred.withColumn("side", F.lit("pred")).unionByName(gt.withColumn("side", F.lit("gt")))
    return rounded(both)


@query("match_features", f"with {_MATCH_SQL} select sample_id, roi_number, feature, round(pred, 6) as pred, round(gt, 6) as gt from matched")
def match_features(spark, sf):
    return rounded(_matched(spark, sf))


@query("feature_metrics", f"with {_METRICS_SQL} select feature, n, {_round_sql(('r2', 'rmse', 'mae', 'pearson_r'))} from metrics")
def feature_metrics(spark, sf):
    return rounded(_metrics(spark, sf))


_SUMMARY_SQL = f"""with {_METRICS_SQL}, summary as (select {_SUMMARY_COLUMNS} from metrics)
    select total_features, {_round_sql(_MEANS)}, features_with_high_correlation, features_with_low_r2 from summary"""


@query("feature_summary", _SUMMARY_SQL)
def feature_summary(spark, sf):
    return rounded(ops.feature_summary(_metrics(spark, sf)))


@query(
    "summary_json",
    f"""with {_METRICS_SQL}, summary as (select {_SUMMARY_COLUMNS} from metrics),
        covered as (select count(*) as num_rows_analyzed, count(distinct sample_id) as num_samples_analyzed,
                    string_agg(distinct sample_id, ',' order by sample_id) as samples_analyzed from wide)
    select total_features, {_round_sql(_MEANS)}, features_with_high_correlation, features_with_low_r2, covered.* from summary, covered""",
)
def summary_json(spark, sf):
    path = scratch_path(spark, "summary")
    pred, gt = _tables(spark, sf)
    joined = pred.select(*ops.KEYS).join(gt.select(*ops.KEYS), ops.KEYS)
    tables.export_summary_json(ops.with_coverage(ops.feature_summary(_metrics(spark, sf)), joined), path)
    kept = tables.read_summary_json(spark, path)
    return rounded(kept.withColumn("samples_analyzed", F.array_join("samples_analyzed", ",")))


@query(
    "data_coverage",
    f"""with {_MATCH_SQL},
        s as (select sample_id, row_number() over (order by sample_id) as rn from (select distinct sample_id from wide))
        select (select count(*) from wide) as num_rows_analyzed, count(*) as num_samples_analyzed,
               concat(string_agg(sample_id, ', ' order by sample_id) filter (rn <= 20),
                      case when count(*) > 20 then concat(' ... and ', count(*) - 20, ' more') else '' end) as samples from s""",
)
def data_coverage(spark, sf):
    pred, gt = _tables(spark, sf)
    return ops.data_coverage(pred.select(*ops.KEYS).join(gt.select(*ops.KEYS), ops.KEYS))


@query("top_features", f"with {_METRICS_SQL} select feature, {_round_sql(('r2', 'rmse', 'mae', 'pearson_r'))} from metrics order by r2 desc nulls last, feature limit 2")
def top_features(spark, sf):
    return rounded(ops.top_features(_metrics(spark, sf), 2))


@query("bottom_features", f"with {_METRICS_SQL} select feature, {_round_sql(('r2', 'rmse', 'mae', 'pearson_r'))} from metrics order by r2 nulls last, feature limit 2")
def bottom_features(spark, sf):
    return rounded(ops.bottom_features(_metrics(spark, sf), 2))


@query(
    "match_blobs",
    """select p.sample_id, p.roi_number, array_to_string(p.mask, '') as pred, array_to_string(g.mask, '') as gt
       from {pred_masks} p join {gt_masks} g on p.sample_id = g.sample_id and p.roi_number = g.roi_number""",
)
def match_blobs(spark, sf):
    text = {c: F.array_join(F.col(c).cast("array<string>"), "") for c in ("pred", "gt")}
    return _masks(spark, sf).withColumns(text)


_BLOB_FIGURES = "iou", "dice", "accuracy"


@query("blob_metrics", f"with {_BLOBS_SQL} select sample_id, roi_number, tp, fp, fn, tn, {_round_sql(_BLOB_FIGURES)}, diff_pixels from blobs")
def blob_metrics(spark, sf):
    return rounded(_blobs(spark, sf))


@query(
    "blob_summary",
    f"""with {_BLOBS_SQL}, summary as (select {_BLOB_SUMMARY_COLUMNS} from blobs)
        select total_blobs, perfect_matches, near_perfect_matches, poor_matches, {_round_sql(_BLOB_MEANS)} from summary""",
)
def blob_summary(spark, sf):
    return rounded(ops.blob_summary(_blobs(spark, sf)))


@query(
    "pixel_classes",
    f"""with {_PIXELS_SQL} select sample_id, roi_number, px,
        case when pred = gt then 'correct' when pred = 1 then 'false_positive' else 'false_negative' end as pixel_class from pixels""",
)
def pixel_classes(spark, sf):
    return ops.pixel_classes(_masks(spark, sf))


@query("pixel_class_counts", f"with {_BLOBS_SQL} select sample_id, roi_number, tp + tn as correct, fp as false_positive, fn as false_negative from blobs")
def pixel_class_counts(spark, sf):
    return ops.pixel_class_counts(_masks(spark, sf))


@query("worst_blobs", f"with {_BLOBS_SQL} select sample_id, roi_number, {_round_sql(_BLOB_FIGURES)}, diff_pixels from blobs order by blobs.iou, sample_id, roi_number limit 10")
def worst_blobs(spark, sf):
    return rounded(ops.worst_blobs(_blobs(spark, sf)))


@query("best_blobs", f"with {_BLOBS_SQL} select sample_id, roi_number, {_round_sql(_BLOB_FIGURES)}, diff_pixels from blobs order by blobs.iou desc, sample_id, roi_number limit 10")
def best_blobs(spark, sf):
    return rounded(ops.best_blobs(_blobs(spark, sf)))


@query(
    "worst_n_for_display",
    f"""with {_BLOBS_SQL}, names as (select case when roi_number % 9 = 0 then concat(sample_id, '-', roi_number)
            else concat(sample_id, '_', roi_number, '_iou', diff_pixels) end as name from blobs)
        select name, case when contains(name, '_iou') then regexp_extract(name, '^(.*)_iou(.*)$', 1) else name end as sample_roi,
               case when contains(name, '_iou') then regexp_extract(name, '^(.*)_iou(.*)$', 2) else 'unknown' end as iou_text
        from names order by name limit 10""",
)
def worst_n_for_display(spark, sf):
    plain = F.concat("sample_id", F.lit("-"), "roi_number")
    scored = F.concat("sample_id", F.lit("_"), "roi_number", F.lit("_iou"), "diff_pixels")
    names = _blobs(spark, sf).select(F.when(F.col("roi_number") % 9 == 0, plain).otherwise(scored).alias("name"))
    return ops.worst_n_for_display(names)


_REPORT_SQL = (
    f"""with {_METRICS_SQL}, {_BLOBS_SQL}, s1 as (select {_SUMMARY_COLUMNS} from metrics), s2 as (select {_BLOB_SUMMARY_COLUMNS} from blobs)
        """
    + " union all ".join(
        f"select '{section}' as section, '{c}' as name, round({c}::double, {1 if c.endswith('_percent') else 4}) as value from {table}"
        for section, table, names in (
            ("features", "s1", ("total_features", *_MEANS, "features_with_high_correlation", "features_with_low_r2")),
            ("blobs", "s2", ("total_blobs", "perfect_matches", "near_perfect_matches", "poor_matches", *_BLOB_MEANS)),
        )
        for c in names
    )
)


@query("report_tables", _REPORT_SQL)
def report_tables(spark, sf):
    return ops.report_tables(ops.feature_summary(_metrics(spark, sf)), ops.blob_summary(_blobs(spark, sf)))


@query("validation_run", _REPORT_SQL)
def validation_run(spark, sf):
    """The whole validation, each task reading the files of the one before, with provenance."""
    root = scratch_path(spark, "validation")
    pred, gt = load(spark, sf, "pred_features"), load(spark, sf, "gt_features")
    masks = (load(spark, sf, "pred_masks"), load(spark, sf, "gt_masks"))
    return validate_run(FlowRun(spark, "validation", f"{root}/prov"), root, pred, gt, masks=masks)
