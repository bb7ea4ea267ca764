import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from binflow.operators import detect

COLUMNS = ["image_id", "frame", "det_id", "class_id", "conf", "x1", "y1", "x2", "y2"]


def _boxes(spark, n, spread, seed, images=3):
    rng = np.random.default_rng(seed)
    x, y = rng.uniform(-spread, spread, n), rng.uniform(-spread, spread, n)
    image = np.where(np.arange(n) % 3 == 0, 0, rng.integers(0, images, n))
    pdf = pd.DataFrame(
        {
            "image_id": [f"img{i}" for i in image],
            "frame": 0,
            "det_id": np.arange(n),
            "class_id": rng.integers(0, 3, n),
            "conf": rng.integers(0, 40, n) / 40,
            "x1": x,
            "y1": y,
            "x2": x + rng.uniform(1, 10, n),
            "y2": y + rng.uniform(1, 10, n),
        }
    )
    return pdf, spark.createDataFrame(pdf[COLUMNS])


def _iou(a, b):
    wide = max(0.0, min(a.x2, b.x2) - max(a.x1, b.x1))
    tall = max(0.0, min(a.y2, b.y2) - max(a.y1, b.y1))
    shared = wide * tall
    union = (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - shared
    return shared / union if union else 0.0


def _brute(pdf, keys, limit=0.5):
    kept = []
    for _, group in pdf.groupby(keys):
        mine = []
        for box in group.sort_values(["conf", "det_id"], ascending=[False, True]).itertuples():
            if all(_iou(box, k) <= limit for k in mine):
                mine.append(box)
        kept += [b.det_id for b in mine]
    return sorted(kept)


@pytest.mark.parametrize("agnostic", [True, False])
@pytest.mark.parametrize("image_boxes, tile_boxes, spread", [(10_000, 1000, 20), (20, 8, 15), (20, 50, 60)])
def test_nms_matches_brute_force(spark, agnostic, image_boxes, tile_boxes, spread):
    pdf, df = _boxes(spark, 120, spread, seed=image_boxes + tile_boxes)
    got = detect.nms(df, 0.5, agnostic, image_boxes=image_boxes, tile_boxes=tile_boxes)
    keys = ["image_id"] if agnostic else ["image_id", "class_id"]
    assert sorted(r.det_id for r in got.select("det_id").collect()) == _brute(pdf, keys)


@pytest.mark.parametrize("limit, n, tile_boxes", [(0.0, 60, 40), (0.3, 150, 40), (0.3, 70, 3)])
def test_nms_of_mixed_sizes(spark, limit, n, tile_boxes):
    """Tiny boxes beside huge ones, in one image above the size limit."""
    rng = np.random.default_rng(11)
    size = 10.0 ** rng.integers(-1, 4, n) * rng.uniform(0.5, 1.0, n)
    x, y = rng.uniform(-30, 30, n), rng.uniform(-30, 30, n)
    pdf = pd.DataFrame({"image_id": "a", "frame": 0, "det_id": np.arange(n), "class_id": 0, "conf": rng.uniform(0, 1, n),
                        "x1": x, "y1": y, "x2": x + size, "y2": y + size * rng.uniform(0.2, 1.0, n)})
    got = detect.nms(spark.createDataFrame(pdf[COLUMNS]), limit, image_boxes=10, tile_boxes=tile_boxes)
    assert sorted(r.det_id for r in got.select("det_id").collect()) == _brute(pdf, ["image_id"], limit)


def test_a_box_over_a_dropped_box_stays(spark):
    rows = [("a", 0, 1, 0, 0.9, 0.0, 0.0, 10.0, 10.0), ("a", 0, 2, 0, 0.8, 3.0, 0.0, 13.0, 10.0), ("a", 0, 3, 0, 0.7, 6.0, 0.0, 16.0, 10.0)]
    df = spark.createDataFrame(rows, "image_id string, frame long, det_id long, class_id int, conf double, x1 double, y1 double, x2 double, y2 double")
    assert {r.det_id for r in detect.nms(df).collect()} == {1, 3}


def test_zero_area_boxes_do_not_fail(spark):
    rows = [("a", 0, i, 0, 0.5, 1.0, 1.0, 1.0, 1.0) for i in range(30)]
    df = spark.createDataFrame(rows, "image_id string, frame long, det_id long, class_id int, conf double, x1 double, y1 double, x2 double, y2 double")
    assert detect.nms(df).count() == 30
    assert detect.nms(df, image_boxes=5, tile_boxes=4).count() == 30


def test_max_det_plan_limits_before_the_shuffle(spark):
    _, df = _boxes(spark, 100, 10, 1)
    limited = detect.max_det(df, 3)
    assert limited.groupBy("image_id").count().agg(F.max("count")).first()[0] == 3
    plan = limited._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_label_files(spark, tmp_path):
    _, df = _boxes(spark, 30, 10, 3)
    status = detect.write_detections(df, str(tmp_path / "labels"), 100.0, 50.0)
    assert status.filter("ok").agg(F.sum("rows")).first()[0] == 30
    lines = (tmp_path / "labels" / "img0.txt").read_text().splitlines()
    assert len(lines) == df.filter("image_id = 'img0'").count() and all(len(line.split()) == 5 for line in lines)
