"""Class scores, model inference and particle-image features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from binflow.bindings import load
from binflow.functions import numeric
from binflow.operators import infer as ops
from binflow.registry import query
from binflow.registry.rounding import rounded
from binflow.session import scratch_path
from binflow.sources.vectors import write_embeddings as write_vectors

CLASSES = 10
_SOFTMAX = """s as (select vec_id, list_transform(logits, lambda v: exp(v - list_max(logits))) as e from {class_scores}),
    p as (select vec_id, list_transform(e, lambda v: v / list_sum(e)) as scores from s)"""


def _scores(spark, sf):
    return load(spark, sf, "class_scores").select("vec_id", numeric.softmax(F.col("logits")).alias("scores"))


@query("softmax", f"with {_SOFTMAX} select vec_id, unnest(range(0, len(scores)))::int as class_id, round(unnest(scores), 6) as score from p")
def softmax(spark, sf):
    return rounded(_scores(spark, sf).select("vec_id", F.posexplode("scores").alias("class_id", "score")))


@query(
    "top_class",
    "select vec_id, (list_position(logits, list_max(logits)) - 1)::int as class_id, round(list_max(logits), 6) as score from {class_scores}",
)
def top_class(spark, sf):
    logits = F.col("logits")
    return rounded(load(spark, sf, "class_scores").select("vec_id", numeric.top_class(logits).alias("class_id"), F.array_max(logits).alias("score")))


@query(
    "label_classes",
    f"""with {_SOFTMAX}, l as (select vec_id, unnest(range(0, len(scores)))::int as class_id, unnest(scores) as score from p)
        select vec_id, class_id, name, round(score, 6) as score from l left join {{classes}} using (class_id)""",
)
def label_classes(spark, sf):
    return rounded(ops.label_classes(_scores(spark, sf), load(spark, sf, "classes")))


def _linear_head():
    """Fixed linear model: weights from a formula, plus all inputs, doubled, as embedding."""
    weights = ((np.arange(64)[:, None] * 7 + np.arange(CLASSES)[None, :] * 3) % 11 - 5) / 10

    def predict(inputs: np.ndarray) -> dict[str, np.ndarray]:
        x = inputs.astype(np.float64)
        return {"scores": x @ weights, "embedding": x * 2}

    return predict


_HEAD_SQL = """x as (select vec_id, unnest(range(0, 64)) as i, unnest(embedding)::double as v from {embeddings}),
    logit as (select vec_id, c::int as class_id, sum(v * (((i * 7 + c * 3) % 11) - 5) / 10e0) as z from x, range(0, 10) t(c) group by all),
    power as (select vec_id, class_id, exp(z - max(z) over (partition by vec_id)) as e from logit),
    prob as (select vec_id, class_id, e / sum(e) over (partition by vec_id) as score from power)"""


def _inputs(spark, sf):
    return load(spark, sf, "embeddings").select("vec_id", "embedding")


@query(
    "model_infer",
    f"""with {_HEAD_SQL} select vec_id, class_id, round(score, 6) as score, round(sum2, 6) as embedding_sum from prob
        join (select vec_id, sum(2 * v * (i + 1)) as sum2 from x group by vec_id) using (vec_id)""",
)
def model_infer(spark, sf):
    out = ops.model_infer(_inputs(spark, sf), _linear_head, "embedding", [64], batch=128, embeddings=True)
    # Each entry counts by its place, so that none can be missing or elsewhere.
    placed = F.transform("embedding", lambda v, i: v.cast("double") * (i + 1))
    total = F.aggregate(placed, F.lit(0.0), lambda acc, v: acc + v)
    return rounded(out.select("vec_id", F.posexplode("scores").alias("class_id", "score"), total.alias("embedding_sum")))


@query(
    "write_embeddings",
    "select vec_id, unnest(range(0, len(embedding)))::int as place, round(2 * unnest(embedding)::double, 5) as value from {embeddings}",
)
def write_embeddings(spark, sf):
    path = scratch_path(spark, "vectors")
    write_vectors(ops.model_infer(_inputs(spark, sf), _linear_head, "embedding", [64], embeddings_only=True), path)
    back = spark.read.parquet(path)
    return rounded(back.select("vec_id", F.posexplode("embedding").alias("place", "value")).withColumn("value", F.col("value").cast("double")), 5)


_ON = """cells as (select sample_id, roi_number, unnest(mask) as v, unnest(range(0, len(mask))) as px, width from {pred_masks}),
    px_on as (select sample_id, roi_number, (px % width)::int as x, (px // width)::int as y, px::int as px from cells where v = 1)"""


@query(
    "map_rois",
    f"""with {_ON} select m.sample_id, m.roi_number, count(px)::int as area, min(x) as x_min, min(y) as y_min, max(x) as x_max, max(y) as y_max,
        round(avg(x), 6) as centroid_x, round(avg(y), 6) as centroid_y,
        round(count(px) / nullif((max(x) - min(x) + 1) * (max(y) - min(y) + 1), 0)::double, 6) as fill
        from {{pred_masks}} m left join px_on p on m.sample_id = p.sample_id and m.roi_number = p.roi_number group by m.sample_id, m.roi_number""",
)
def map_rois(spark, sf):
    return rounded(ops.roi_features(load(spark, sf, "pred_masks")))


@query(
    "map_rois_multiblob",
    f"""with recursive {_ON},
        near as (select a.sample_id, a.roi_number, a.px as a, b.px as b from px_on a join px_on b
                 on a.sample_id = b.sample_id and a.roi_number = b.roi_number and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1),
        reach as (select sample_id, roi_number, a, b from near union
                  select r.sample_id, r.roi_number, r.a, n.b from reach r join near n
                  on r.sample_id = n.sample_id and r.roi_number = n.roi_number and r.b = n.a),
        part as (select sample_id, roi_number, a as px, min(b) as first from reach group by all),
        blobs as (select p.sample_id, p.roi_number, first, count(*)::int as area, min(x) as x_min, min(y) as y_min, max(x) as x_max, max(y) as y_max
                  from part p join px_on o on p.sample_id = o.sample_id and p.roi_number = o.roi_number and p.px = o.px group by all)
        select sample_id, roi_number, (row_number() over (partition by sample_id, roi_number order by first) - 1)::int as blob,
               area, x_min, y_min, x_max, y_max from blobs""",
)
def map_rois_multiblob(spark, sf):
    return ops.roi_blobs(load(spark, sf, "pred_masks"))
