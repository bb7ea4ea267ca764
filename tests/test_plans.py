"""Whole runs: what they write, what they note, and where they stop."""

import json

import pytest
from pyspark.sql import functions as F

from binflow.params import ForestParams
from binflow.plans.flow import FlowRun
from binflow.plans.training import train_run
from binflow.plans.validation import validate_run


def tables(spark):
    gt = spark.createDataFrame([("s1", 1, 1.0), ("s1", 2, 2.0), ("s2", 1, 4.0), ("s3", 9, 9.0)], "ifcb_bin string, roi_number int, area double")
    pred = spark.createDataFrame([("s1", 1, 1.5), ("s1", 2, 2.0), ("s2", 1, 3.0)], "sample_id string, roi_number int, area double")
    masks = spark.createDataFrame([("s1", 1, [1, 0]), ("s2", 1, [1, 1])], "sample_id string, roi_number int, mask array<int>")
    return pred, gt, (masks, masks)


def test_validation_writes_and_notes_each_task(spark, tmp_path):
    pred, gt, masks = tables(spark)
    out = str(tmp_path / "out")
    report = validate_run(FlowRun(spark, "v1", str(tmp_path / "prov")), out, pred, gt, masks=masks)
    values = {(r.section, r.name): r.value for r in report.collect()}
    assert values["features", "total_features"] == 1 and values["blobs", "total_blobs"] == 2 and values["blobs", "mean_iou"] == 1
    part = next((tmp_path / "out" / "summary").glob("part-*.json"))
    summary = json.loads(part.read_text())
    assert summary["num_rows_analyzed"] == 3 and summary["samples_analyzed"] == ["s1", "s2"]
    assert spark.read.csv(f"{out}/feature_metrics", header=True).count() == 1
    edges = spark.read.parquet(str(tmp_path / "prov" / "prov_edge"))
    assert sorted(r.run_id for r in edges.collect()) == ["v1_blob_comparison-0", "v1_feature_validation-0", "v1_validation_report-0"]
    assert spark.read.parquet(str(tmp_path / "prov" / "prov_node")).count() == 4


def test_validation_of_listed_samples_without_masks(spark, tmp_path):
    pred, gt, _ = tables(spark)
    report = validate_run(FlowRun(spark, "v2"), str(tmp_path), pred, gt, sample_ids=["s1"])
    assert {r.section for r in report.collect()} == {"features"}
    summary = json.loads(next((tmp_path / "summary").glob("part-*.json")).read_text())
    assert summary["num_rows_analyzed"] == 2 and summary["samples_analyzed"] == ["s1"]


def test_a_failed_task_is_not_noted(spark, tmp_path):
    flow = FlowRun(spark, "f", str(tmp_path))
    assert flow.task("a", lambda: 3) == 3 and flow.task("a", lambda: 4) == 4
    with pytest.raises(RuntimeError, match="no"):
        flow.task("b", lambda: (_ for _ in ()).throw(RuntimeError("no")))
    assert sorted(r.object for r in spark.read.parquet(f"{tmp_path}/prov_edge").collect()) == ["task-a-0", "task-a-1"]


def test_training_by_type_and_by_list(spark, tmp_path):
    ids = [f"{kind}{i}" for kind in "ID" for i in range(8)]
    bins = spark.createDataFrame([(b,) for b in ids], "bin_id string")
    points = bins.crossJoin(spark.range(12)).select(
        "bin_id", F.col("id").alias("seq"), F.col("id").alias("trigger_id"),
        (F.xxhash64("bin_id", "id", F.lit("x")) % 1000 / 1000.0).alias("x"), (F.xxhash64("bin_id", "id") % 1000 / 1000.0).alias("y"),
        F.lit(True).alias("has_roi"),
    )
    params = ForestParams(trees=3, max_samples=64, seed=1)
    model = train_run(FlowRun(spark, "t", str(tmp_path / "prov")), str(tmp_path / "i"), bins, points, "I", params=params)
    rows = model.nodes.where("feature is null").groupBy("tree_id").agg(F.sum("size").alias("n")).collect()
    assert [r.n for r in rows] == [8, 8, 8]
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "i" / "ids")).collect()) == [f"I{i}" for i in range(8)]
    listed = bins.where("bin_id in ('I1', 'D2', 'D3')")
    only_mean = {"spatial_stats": {"mean_x": True}}
    mixed = train_run(FlowRun(spark, "t2"), str(tmp_path / "l"), bins, points, "I", listed.union(listed), params, only_mean)
    assert mixed.nodes.where("feature is null").groupBy("tree_id").agg(F.sum("size").alias("n")).first().n == 3
    assert not (tmp_path / "l" / "ids").exists()
    for kind, given in (("X", None), ("I", listed.limit(0))):
        with pytest.raises(ValueError):
            train_run(FlowRun(spark, "t3", str(tmp_path / "none")), str(tmp_path / "n"), bins, points, kind, given, params)
    assert not (tmp_path / "none").exists() and not (tmp_path / "n").exists()
