import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from binflow.functions import numeric
from binflow.operators import features, infer, runs, scores, validation
from binflow.params import FEATURE_NAMES, enabled_features
from binflow.plans.resume import plan_run, resume_run
from binflow.sources.manifest import Ledger
from binflow.streaming.incremental import run_incremental, stream_files

POINTS = "bin_id string, seq bigint, trigger_id bigint, x double, y double, has_roi boolean"


def test_switches():
    assert enabled_features() == list(FEATURE_NAMES) and len(FEATURE_NAMES) == 27
    off = enabled_features({"spatial_stats": {"mean_x": False}, "unknown": {"z": False}})
    assert "mean_x" not in off and len(off) == 26


def test_edge_bins_give_null_not_errors(spark):
    rows = [("one", 1, 1, 0.5, 0.5, True)]
    rows += [("flat", i, i, 0.5, i / 20, True) for i in range(12)]
    rows += [("none", 1, 1, 0.1, 0.1, False)]
    rows += [("gaps", i, 1, None if i % 2 else 0.3 * i, None, True) for i in range(4)]
    got = {r.bin_id: r for r in features.flow_features(spark.createDataFrame(rows, POINTS)).collect()}
    assert set(got) == {"one", "flat", "none", "gaps"}
    assert got["one"].std_x == 0 and got["one"].skew_x is None and got["one"].angle is None and got["one"].cv_x is None
    assert got["one"].t_y_var is None and got["one"].ratio_spread is None and got["one"].max_duplicate_fraction == 1
    assert got["flat"].cv_x is None and got["flat"].cv_y is not None and got["flat"].core_fraction == pytest.approx(0.5)
    assert got["none"].mean_x is None and got["none"].roi_trigger_fraction == 0
    assert got["gaps"].mean_x == pytest.approx(0.3) and got["gaps"].mean_y is None


def test_fractions_stay_in_range(spark, small):
    from binflow.bindings import load

    for r in features.flow_features(load(spark, small, "points")).collect():
        for name in FEATURE_NAMES:
            if name.endswith("_fraction"):
                assert 0 <= r[name] <= 1
        assert r.total_edge_fraction <= sum(r[f"{s}_edge_fraction"] for s in ("left", "right", "top", "bottom")) + 1e-12


def test_switched_off_groups_are_not_computed(spark, small):
    from binflow.bindings import load

    off = {g: dict.fromkeys(n, False) for g, n in features.FEATURE_GROUPS.items() if g != "edge_features"}
    plan = features.flow_features(load(spark, small, "points"), off)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and plan.count("Exchange hashpartitioning") <= 2


def test_feature_metrics(spark):
    pred = spark.createDataFrame([("s", 1, 1.0, 2.0, 5.0), ("s", 2, 2.0, 2.0, None), ("s", 3, 4.0, 2.0, 1.0), ("t", 9, 9.0, 9.0, 9.0)], "sample_id string, roi_number long, a double, b double, c double")
    gt = spark.createDataFrame([("s", 1, 1.0, 1.0, 5.0), ("s", 2, 2.0, 2.0, 7.0), ("s", 3, 3.0, 3.0, 3.0)], "sample_id string, roi_number long, a double, b double, c double")
    rows = {r.feature: r for r in validation.feature_metrics(pred, gt).collect()}
    assert rows["a"].n == 3 and rows["a"].r2 == pytest.approx(0.5) and rows["a"].mae == pytest.approx(1 / 3)
    assert rows["b"].pearson_r is None and rows["b"].r2 == pytest.approx(0.0)
    assert rows["c"].n == 2 and rows["c"].r2 == pytest.approx(-1.0) and rows["c"].pearson_r == pytest.approx(1.0)
    again = {r.feature: r for r in validation.metrics_of_matched(validation.match_features(pred, gt)).collect()}
    for name, row in rows.items():
        assert again[name].n == row.n and again[name].r2 == pytest.approx(row.r2)


def test_blob_metrics_of_empty_and_equal_masks(spark):
    schema = "sample_id string, roi_number long, mask array<int>"
    pred = spark.createDataFrame([("s", 1, [0, 0]), ("s", 2, [1, 1]), ("s", 3, [1, 0]), ("s", 4, [1, 1])], schema)
    gt = spark.createDataFrame([("s", 1, [0, 0]), ("s", 2, [1, 1]), ("s", 3, [0, 1])], schema)
    metrics = validation.blob_metrics(validation.match_blobs(pred, gt))
    rows = {r.roi_number: r for r in metrics.collect()}
    assert (rows[1].iou, rows[1].dice, rows[1].accuracy) == (1.0, 1.0, 1.0)
    assert rows[2].iou == 1.0 and rows[3].iou == 0.0 and rows[3].diff_pixels == 2 and len(rows) == 3
    assert all(r.tp + r.fp + r.fn + r.tn == 2 for r in rows.values())
    total = validation.blob_summary(metrics, task_rows=1).first()
    assert total.total_blobs == 3 and total.median_iou == 1.0 and total.perfect_matches == 2 and total.poor_matches_percent == pytest.approx(100 / 3)
    none = validation.blob_summary(metrics.limit(0)).first()
    assert none.total_blobs == 0 and none.mean_iou is None and none.perfect_matches_percent is None


def test_coverage_text(spark):
    df = spark.range(23).select(F.format_string("s%02d", "id").alias("sample_id"), "id")
    row = validation.data_coverage(df.unionByName(df)).first()
    assert row.num_rows_analyzed == 46 and row.num_samples_analyzed == 23
    assert row.samples.startswith("s00, s01") and row.samples.endswith("s19 ... and 3 more")
    assert validation.data_coverage(df.filter("id < 2")).first().samples == "s00, s01"


def test_display_names(spark):
    df = spark.createDataFrame([("b_iou0.5",), ("a_iou_x_iou0.25",), ("plain",)], "name string")
    rows = validation.worst_n_for_display(df, 3).collect()
    assert [tuple(r) for r in rows] == [("a_iou_x_iou0.25", "a_iou_x", "0.25"), ("b_iou0.5", "b", "0.5"), ("plain", "plain", "unknown")]


def test_ranked_features_break_ties_by_name(spark):
    df = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", None), ("d", 0.9)], "feature string, r2 double")
    df = df.withColumns({c: F.lit(0.0) for c in ("rmse", "mae", "pearson_r")})
    assert [r.feature for r in validation.top_features(df).collect()] == ["d", "a", "b", "c"]
    assert [r.feature for r in validation.bottom_features(df, 3).collect()] == ["a", "b", "d"]


def test_scopes_need_both_sides(spark):
    rows = [("bad", "I1", 0.5), ("normal", "I2", 0.1), ("normal", "D3", 0.2)]
    df = spark.createDataFrame(rows, "label string, bin_id string, score double")
    got = scores.bad_vs_normal(df)
    assert {r.scope for r in got.collect()} == {"I", "merged"} and got.count() == 5
    spread = scores.score_distribution(got, ["scope", "label"], task_rows=1).orderBy("scope", "label").collect()
    plain = scores.score_distribution(got, ["scope", "label"]).orderBy("scope", "label").collect()
    assert spread == plain


@pytest.mark.parametrize("files, workers, sizes", [(5, 4, [2, 2, 1]), (6, 3, [2, 2, 2]), (2, 9, [1, 1]), (7, 1, [7])])
def test_chunks(spark, files, workers, sizes):
    df = spark.range(files).select(F.format_string("/f%02d", "id").alias("path")).repartition(3)
    rows = sorted((r.path, r.chunk) for r in runs.contiguous_chunks(df, workers).collect())
    assert [c for _, c in rows] == sorted(c for _, c in rows)
    assert [sum(1 for _, c in rows if c == k) for k in range(len(sizes))] == sizes


def _failing_on_seven():
    def process(paths):
        for path in paths:
            if path.endswith("7.avi"):
                raise ValueError(f"bad {path}")

    return process


def test_resume(spark, tmp_path):
    files = spark.range(40).select(F.format_string("/v%02d.avi", "id").alias("path"), F.lit(1).alias("size"), F.unhex(F.lit("524946460000000041564920")).alias("head"))
    done = spark.createDataFrame([("/v03.avi",)], "path string")
    path = str(tmp_path / "manifest")
    plan = plan_run(files, done, workers=3, batch_size=6)
    assert plan.count() == 39 and plan.groupBy("chunk", "batch").count().agg(F.max("count")).first()[0] == 6
    status = resume_run(plan, path, "r1", _failing_on_seven())
    bad = {r.path: r.error for r in runs.failed_units(status).collect()}
    assert set(bad) == {"/v07.avi", "/v17.avi", "/v27.avi", "/v37.avi"} and bad["/v07.avi"] == "bad /v07.avi"
    again = resume_run(plan, path, "r2", lambda paths: None)
    assert again.count() == 4 and again.filter("ok").count() == 4
    summary = runs.run_summary(status).first()
    assert summary.failed == 4 and not summary.archive_run_failed and summary.inference_run_failed


def test_incremental_runs(spark, tmp_path):
    root, status, checkpoint = (str(tmp_path / n) for n in ("in", "status", "checkpoint"))
    (tmp_path / "in").mkdir()
    for i in (1, 7):
        (tmp_path / "in" / f"{i}.avi").write_bytes(b"x")
    seen = []

    def run():
        state = run_incremental(stream_files(spark, root), _failing_on_seven(), status, checkpoint, buckets=4)
        tries = Ledger(spark, status).table().groupBy("path").count()
        seen.append(sorted((r.path.split("/")[-1], r.ok, r["count"]) for r in state.join(tries, "path").collect()))

    run()
    (tmp_path / "in" / "2.avi").write_bytes(b"x")
    run()
    run()  # nothing has arrived: the failed file is tried all the same
    assert seen == [
        [("1.avi", True, 1), ("7.avi", False, 1)],
        [("1.avi", True, 1), ("2.avi", True, 1), ("7.avi", False, 2)],
        [("1.avi", True, 1), ("2.avi", True, 1), ("7.avi", False, 3)],
    ]


def flood(grid):
    """Parts of a mask by flooding pixel by pixel."""
    free, out = grid.copy(), []
    for y, x in np.argwhere(grid):
        if not free[y, x]:
            continue
        free[y, x] = False
        part, edge = [(y, x)], [(y, x)]
        while edge:
            cy, cx = edge.pop()
            for ny in range(max(0, cy - 1), min(grid.shape[0], cy + 2)):
                for nx in range(max(0, cx - 1), min(grid.shape[1], cx + 2)):
                    if free[ny, nx]:
                        free[ny, nx] = False
                        part.append((ny, nx))
                        edge.append((ny, nx))
        p = np.array(part)
        out.append((len(p), p[:, 1].min(), p[:, 0].min(), p[:, 1].max(), p[:, 0].max()))
    return out


def test_blobs_by_runs_equal_flooding():
    rng = np.random.default_rng(0)
    for _ in range(150):
        grid = rng.random((rng.integers(1, 14), rng.integers(1, 14))) < rng.random()
        assert [tuple(r) for r in zip(*infer._blobs(grid))] == flood(grid)
    snake = np.zeros((61, 61), bool)
    snake[::2], snake[1::4, -1], snake[3::4, 0] = True, True, True
    comb = np.zeros((60, 60), bool)
    comb[:, ::2], comb[-1] = True, True
    for grid in (snake, comb, np.zeros((3, 3), bool), np.ones((5, 1), bool)):
        assert [tuple(r) for r in zip(*infer._blobs(grid))] == flood(grid)


def test_blobs_of_missing_and_empty_masks(spark):
    rows = [("a", 1, 2, None), ("a", 2, 2, []), ("a", 3, 2, [1, 0, 0, 1]), ("a", 4, 2, [0, 0, 0, 0])]
    df = spark.createDataFrame(rows, "sample_id string, roi_number long, width int, mask array<int>")
    assert [tuple(r) for r in infer.roi_blobs(df).collect()] == [("a", 3, 0, 2, 0, 0, 1, 1)]
    assert infer.roi_blobs(df.where("roi_number = 1")).count() == 0


def test_softmax_and_top_class(spark):
    df = spark.createDataFrame([([1000.0, 0.0],), ([0.25, 0.75],), ([2.0, 2.0],)], "s array<double>")
    rows = df.select(numeric.softmax(F.col("s")).alias("p"), numeric.top_class(F.col("s")).alias("c")).collect()
    assert rows[0].p == [1.0, 0.0] and rows[1].p == [0.25, 0.75] and rows[2].p == [0.5, 0.5]
    assert [r.c for r in rows] == [0, 1, 0]


def test_model_infer_outputs(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, v array<double>")

    def make():
        return lambda x: {"scores": x * 2, "embedding": x + 1}

    both = infer.model_infer(df, make, "v", [2], embeddings=True, ensure_softmax=False).orderBy("vec_id").collect()
    assert both[3].scores == [6.0, 2.0] and both[3].embedding == [4.0, 2.0]
    assert infer.model_infer(df, make, "v", [2]).columns == ["vec_id", "scores"]
    assert infer.model_infer(df, make, "v", [2], embeddings_only=True).columns == ["vec_id", "embedding"]


def test_roi_features_and_blobs(spark):
    masks = [("s", 1, 3, [1, 0, 0, 0, 1, 0, 0, 0, 0]), ("s", 2, 3, [0] * 9), ("t", 3, 3, [1, 0, 1, 0, 0, 0, 1, 1, 0])]
    df = spark.createDataFrame(masks, "sample_id string, roi_number long, width int, mask array<int>")
    rows = {r.roi_number: r for r in infer.roi_features(df).collect()}
    assert (rows[1].area, rows[1].x_max, rows[1].y_max, rows[1].centroid_x, rows[1].fill) == (2, 1, 1, 0.5, 0.5)
    assert rows[2].area == 0 and rows[2].fill is None and rows[2].x_min is None
    blobs = [(r.roi_number, r.blob, r.area) for r in infer.roi_blobs(df).orderBy("roi_number", "blob").collect()]
    assert blobs == [(1, 0, 2), (3, 0, 1), (3, 1, 1), (3, 2, 2)]


def test_map_rois_batches(spark):
    df = spark.range(0, 70, 1, 1).select(F.lit("s").alias("sample_id"), F.col("id").alias("roi_number"))

    def sizes(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [len(pdf)]})

    got = sorted(r.n for r in infer.map_rois(df, sizes, "n int", min_batch=4, max_batch=64).collect())
    assert got == [6, 64]
    assert sorted(r.n for r in infer.map_rois(df.limit(67), sizes, "n int").collect()) == [1, 1, 1, 64]
    assert infer.map_rois(df, sizes, "n int", bins=["other"]).count() == 0


def test_box_iou(spark):
    df = spark.createDataFrame([(0.0, 0.0, 2.0, 2.0, 1.0, 0.0, 3.0, 2.0), (0.0, 0.0, 1.0, 1.0, 5.0, 5.0, 6.0, 6.0), (1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)], "a double, b double, c double, d double, e double, f double, g double, h double")
    cols = ["x1", "y1", "x2", "y2"]
    iou = numeric.box_iou(dict(zip(cols, map(F.col, "abcd"))), dict(zip(cols, map(F.col, "efgh"))))
    got = [r[0] for r in df.select(iou).collect()]
    assert got[0] == pytest.approx(1 / 3) and got[1] == 0 and got[2] is None
    assert np.isclose(got[0], 1 / 3)


def test_masks_that_cannot_be_compared(spark):
    from binflow.operators.validation import blob_metrics, blob_summary

    rows = [("a", 1, [1, 0], [1, 0]), ("a", 2, None, [1, 0]), ("a", 3, [1, 0], [1, 0, 1, 1]), ("a", 4, [], [])]
    matched = spark.createDataFrame(rows, "sample_id string, roi_number int, pred array<int>, gt array<int>")
    out = {r.roi_number: (r.iou, r.dice, r.tp, r.diff_pixels) for r in blob_metrics(matched).collect()}
    assert out == {1: (1.0, 1.0, 1, 0), 2: (None,) * 4, 3: (None,) * 4, 4: (1.0, 1.0, 0, 0)}
    assert blob_summary(blob_metrics(matched)).first().perfect_matches == 2


def test_softmax_and_class_names(spark):
    import math

    from pyspark.sql import functions as F

    from binflow.functions.numeric import softmax
    from binflow.operators.infer import label_classes

    scores = spark.createDataFrame([(1, [0.0, 2.0, -1.0])], "id int, scores array<double>")
    out = scores.select(softmax(F.col("scores")).alias("s")).first().s
    whole = sum(math.exp(v) for v in (0.0, 2.0, -1.0))
    assert all(abs(a - math.exp(v) / whole) < 1e-12 for a, v in zip(out, (0.0, 2.0, -1.0)))
    names = spark.createDataFrame([(0, "zero")], "class_id int, name string")
    got = sorted((r.class_id, r.name) for r in label_classes(scores, names).collect())
    assert got == [(0, "zero"), (1, None), (2, None)]
