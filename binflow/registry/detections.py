"""Detection post-processing."""

from __future__ import annotations

from pyspark.sql import functions as F

from binflow.bindings import load
from binflow.functions import text
from binflow.functions.numeric import box_iou
from binflow.operators import detect as ops
from binflow.params import DetectParams
from binflow.registry import query
from binflow.registry.rounding import rounded
from binflow.session import scratch_path

_ALL = "image_id, frame, det_id, class_id, conf, x1, y1, x2, y2"


def _iou_sql(a: str, b: str) -> str:
    shared = f"greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
    area = f"({a}.x2-{a}.x1)*({a}.y2-{a}.y1) + ({b}.x2-{b}.x1)*({b}.y2-{b}.y1)"
    return f"({shared}) / nullif({area} - ({shared}), 0)"


def _nms_sql(source: str, keys: str) -> str:
    """Greedy suppression as a walk over the boxes of a group by rank."""
    match = " and ".join(f"w.{k.strip()} = d.{k.strip()}" for k in keys.split(","))
    same = ", ".join(f"w.{k.strip()}" for k in keys.split(","))
    return f"""ranked as (select *, row_number() over (partition by {keys} order by conf desc, det_id) as rn from {source}),
    walk as (select distinct {keys}, 0::bigint as rn, []::struct(det_id bigint, x1 double, y1 double, x2 double, y2 double)[] as kept from ranked
             union all
             select {same}, d.rn,
                    case when len(list_filter(w.kept, lambda k: coalesce({_iou_sql('k', 'd')}, 0) > 0.5)) > 0 then w.kept
                         else list_append(w.kept, struct_pack(det_id := d.det_id, x1 := d.x1, y1 := d.y1, x2 := d.x2, y2 := d.y2)) end
             from walk w join ranked d on {match} and d.rn = w.rn + 1),
    last as (select {keys}, max_by(kept, rn) as kept from walk group by {keys}),
    ids as (select unnest(list_transform(kept, lambda k: k.det_id)) as det_id from last),
    kept as (select r.* from ranked r join ids using (det_id))""".replace("{{", "{").replace("}}", "}")


@query("filter_detections", f"select {_ALL} from {{detections}} where conf >= 0.1 and class_id in (0, 2, 4)")
def filter_detections(spark, sf):
    return ops.filter_detections(load(spark, sf, "detections"), 0.1, [0, 2, 4])


@query("frame_stride", f"select {_ALL} from {{detections}} where frame % 3 = 0")
def frame_stride(spark, sf):
    return ops.frame_stride(load(spark, sf, "detections"), 3)


@query("max_det", f"select {_ALL} from (select *, row_number() over (partition by image_id order by conf desc, det_id) as rn from {{detections}}) where rn <= 20")
def max_det(spark, sf):
    return ops.max_det(load(spark, sf, "detections"), 20)


@query(
    "box_iou",
    f"""with a as (select *, struct_pack(x1 := x1 + det_id % 9, y1 := y1 + det_id % 7, x2 := x2 + 3, y2 := y2 + det_id % 30) as p from {{detections}})
        select image_id, det_id, round({_iou_sql('a', 'p')}, 6) as iou from a""",
)
def iou(spark, sf):
    """Overlap of each box with a shifted and stretched copy of it."""
    shift = {"x1": F.col("det_id") % 9, "y1": F.col("det_id") % 7, "x2": F.lit(3), "y2": F.col("det_id") % 30}
    other = {c: F.col(c) + by for c, by in shift.items()}
    overlap = box_iou({c: F.col(c) for c in ops.BOX}, other)
    return rounded(load(spark, sf, "detections").select("image_id", "det_id", overlap.alias("iou")))


_NMS = f"""with recursive boxes as (select * from {{detections}} where conf >= 0.1),
    {_nms_sql('boxes', 'image_id')} select {_ALL} from kept"""


@query("nms", _NMS)
def nms(spark, sf):
    return ops.nms(ops.filter_detections(load(spark, sf, "detections")))


_NMS_CLASS = f"""with recursive boxes as (select * from {{detections}} where conf >= 0.1),
    {_nms_sql('boxes', 'image_id, class_id')} select {_ALL} from kept"""


@query("nms_per_class", _NMS_CLASS)
def nms_per_class(spark, sf):
    return ops.nms(ops.filter_detections(load(spark, sf, "detections")), agnostic=False)


@query(
    "detect_postprocess",
    f"""with recursive boxes as (select * from {{detections}} where conf >= 0.2 and frame % 2 = 0 and class_id in (0, 1, 3)),
        {_nms_sql('boxes', 'image_id')},
        limited as (select *, row_number() over (partition by image_id order by conf desc, det_id) as place from kept)
        select {_ALL} from limited where place <= 5""",
)
def detect_postprocess(spark, sf):
    return ops.detect_postprocess(load(spark, sf, "detections"), DetectParams(conf=0.2, classes=(0, 1, 3), max_det=5, vid_stride=2))


@query(
    "write_detections",
    """select image_id, concat(class_id, ' ', printf('%.6f', (x1 + x2) / 2 / 200e0), ' ', printf('%.6f', (y1 + y2) / 2 / 200e0), ' ',
              printf('%.6f', (x2 - x1) / 200e0), ' ', printf('%.6f', (y2 - y1) / 200e0), ' ', printf('%.6f', conf)) as line
       from {detections}""",
)
def write_detections(spark, sf):
    folder = scratch_path(spark, "labels")
    status = ops.write_detections(load(spark, sf, "detections"), folder, 200.0, 200.0, save_conf=True)
    written = status.filter("ok").count()
    lines = spark.read.text(folder).select(text.base_name(F.col("_metadata.file_name")).alias("image_id"), F.col("value").alias("line"))
    return lines if written else lines.limit(0)
