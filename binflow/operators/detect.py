"""Detection post-processing. Boxes are image_id, frame, det_id, class_id, conf, x1, y1, x2, y2."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binflow.functions.numeric import box_iou
from binflow.functions.scale import hot_keys
from binflow.params import DetectParams
from binflow.session import materialize
from binflow.sources.named import write_named
from binflow.sources.store import Files

#: An image with more boxes than this is suppressed tile by tile.
IMAGE_BOXES = 20_000
#: Boxes of one tile that a round looks at.
TILE_BOXES = 1_000
BOX = ["x1", "y1", "x2", "y2"]


def filter_detections(detections: DataFrame, conf: float = 0.1, classes: list[int] | tuple[int, ...] | None = None) -> DataFrame:
    kept = detections.filter(F.col("conf") >= conf)
    return kept if classes is None else kept.filter(F.col("class_id").isin(list(classes)))


def frame_stride(detections: DataFrame, vid_stride: int = 1) -> DataFrame:
    """Every n-th frame, from frame 0."""
    return detections.filter(F.col("frame") % vid_stride == 0)


def max_det(detections: DataFrame, n: int = 300, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """At most ``n`` boxes per image by confidence. Spark limits each group before the
    shuffle as well, so a huge image sends at most ``n`` boxes per task."""
    order = Window.partitionBy(*by).orderBy(F.desc("conf"), F.asc("det_id"))
    return detections.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= n).drop("_rn")


def _overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of boxes, broadcast as NumPy does; 0 where both have no area."""
    wide = np.minimum(a[..., 2], b[..., 2]) - np.maximum(a[..., 0], b[..., 0])
    tall = np.minimum(a[..., 3], b[..., 3]) - np.maximum(a[..., 1], b[..., 1])
    shared = np.maximum(wide, 0.0) * np.maximum(tall, 0.0)
    areas = [(box[..., 2] - box[..., 0]) * (box[..., 3] - box[..., 1]) for box in (a, b)]
    union = areas[0] + areas[1] - shared
    return np.divide(shared, union, out=np.zeros_like(shared), where=union != 0)


def _greedy(boxes: np.ndarray, iou: float, block: int = 512) -> np.ndarray:
    """Mask of the kept boxes; ``boxes`` are in rank order.

    Overlaps are taken block by block, so memory stays at block x boxes.
    """
    alive = np.ones(len(boxes), dtype=bool)
    for start in range(0, len(boxes), block):
        stop = min(start + block, len(boxes))
        rows = start + np.flatnonzero(alive[start:stop])
        meets = _overlap(boxes[rows, None], boxes[None, start:]) > iou
        for row, hit in zip(rows, meets):
            if alive[row]:
                alive[row + 1 :] &= ~hit[row + 1 - start :]
    return alive


def _ranked(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["conf", "det_id"], ascending=[False, True], ignore_index=True)


def nms(
    detections: DataFrame,
    iou: float = 0.5,
    agnostic: bool = True,
    by: tuple[str, ...] = ("image_id",),
    image_boxes: int = IMAGE_BOXES,
    tile_boxes: int = TILE_BOXES,
) -> DataFrame:
    """Greedy suppression: by confidence, drop a box that overlaps a kept one by more than ``iou``.

    Boxes compete inside an image, or inside (image, class) unless ``agnostic``.
    An image of ordinary size is one group; a larger one goes through
    :func:`_nms_by_tile`, with the same result. ``det_id`` is unique in an image.
    """
    keys = [*by]
    columns = detections.columns

    def keep(group: pa.Table) -> pa.Table:
        conf, det_id = (group.column(c).to_numpy() for c in ("conf", "det_id"))
        order = np.lexsort((det_id, -conf))
        boxes = np.column_stack([group.column(c).to_numpy() for c in BOX])[order].astype(float)
        if agnostic:
            return group.take(order[_greedy(boxes, iou)])
        kind = group.column("class_id").to_numpy()[order]
        alive = np.zeros(len(order), dtype=bool)
        for one in np.unique(kind):
            mine = np.flatnonzero(kind == one)
            alive[mine] = _greedy(boxes[mine], iou)
        return group.take(order[alive])

    def per_group(df: DataFrame) -> DataFrame:
        # A set number of partitions: the work is in Python, so small bytes must not mean one task.
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return df.repartition(parts, *keys).groupBy(*keys).applyInArrow(keep, detections.schema)

    hot = hot_keys(detections, keys, image_boxes)
    if hot is None:
        return per_group(detections)
    ordinary = detections.join(hot, keys, "left_anti").select(*columns)
    large = detections.join(hot, keys, "left_semi").select(*columns)
    compete = keys if agnostic else [*keys, "class_id"]
    return per_group(ordinary).unionByName(_nms_by_tile(large, iou, keys, compete, tile_boxes))


def _nms_by_tile(detections: DataFrame, iou: float, images: list[str], keys: list[str], tile_boxes: int) -> DataFrame:
    """Exact greedy suppression of images too large for one task.

    Boxes lie in tiles of their size level, so small boxes keep small tiles beside
    large ones; :func:`_meeting_tiles` gives the tiles where a box can meet a rival.
    Each round shows every tile the best undecided boxes around it, keeps
    those whose better overlapping boxes are all known to be dropped, and then
    removes everything that overlaps a kept box. The best undecided box is always
    decided, so the rounds end; nothing is left out.
    """
    tile = [*keys, "_level", "_tx", "_ty"]
    columns = detections.columns
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.lit(1e-9))
    if iou > 0.05:
        # IoU is at most the ratio of the longer sides, so rivals are at most one level apart.
        base = 1.01 * max(2.0, 1.0 / iou)
        leveled = detections.withColumn("_level", F.floor(F.log(side) / F.log(F.lit(base))).cast("int"))
        leveled = leveled.withColumn("_unit", F.lit(base))
    else:
        # One row per image above the size limit.
        longest = detections.groupBy(*images).agg((F.max(side) * 1.01).alias("_unit"))
        leveled = detections.join(F.broadcast(longest), images).withColumn("_level", F.lit(0))
    placed = leveled.withColumns({"_tx": _tile_of(F.col("x1"), F.col("_level")), "_ty": _tile_of(F.col("y1"), F.col("_level"))})
    undecided = materialize(placed.select(*columns, "_unit", "_level", "_tx", "_ty"))
    best = Window.partitionBy(*tile).orderBy(F.desc("conf"), F.asc("det_id"))
    cut = F.col("_more") & (F.col("_rn") == tile_boxes)
    kept: list[DataFrame] = []
    small = [*tile, "_unit", "det_id", "conf", *BOX]
    while not undecided.isEmpty():
        sizes = undecided.groupBy(*tile).agg((F.count(F.lit(1)) > tile_boxes).alias("_more"))
        top = undecided.select(*small).withColumn("_rn", F.row_number().over(best)).filter(F.col("_rn") <= tile_boxes)
        shown = _meeting_tiles(top.join(sizes, tile).withColumn("_cut", cut), iou, "_cut").select(
            *keys,
            *[F.col(f"_at.{c}").alias(f"_{c}") for c in ("level", "tx", "ty")],
            ((F.col("_at.level") == F.col("_level")) & (F.col("_at.tx") == F.col("_tx")) & (F.col("_at.ty") == F.col("_ty"))).alias("_own"),
            "_cut",
            "det_id",
            "conf",
            *BOX,
        )
        schema = undecided.select(*tile, "det_id").schema
        chosen = shown.groupBy(*tile).applyInPandas(_decider(iou, tile), schema)
        kept.append(materialize(undecided.join(chosen, [*tile, "det_id"], "left_semi")))
        suppressors = _meeting_tiles(kept[-1].select(*small), iou).select(
            *keys,
            *[F.col(f"_at.{c}").alias(f"_{c}") for c in ("level", "tx", "ty")],
            F.col("det_id").alias("_det"),
            *[F.col(c).alias(f"_{c}") for c in BOX],
        )
        condition = (F.col("u.det_id") == F.col("s._det")) | (_iou_columns() > iou)
        for k in tile:
            condition = (F.col(f"u.{k}") == F.col(f"s.{k}")) & condition
        undecided = materialize(undecided.alias("u").join(suppressors.alias("s"), condition, "left_anti"))
    out = kept[0]
    for part in kept[1:]:
        out = out.unionByName(part)
    return out.select(*columns)


def _tile_of(edge: Column, level: Column) -> Column:
    """Tile number of a coordinate; tiles of a level are wider than its boxes."""
    return F.floor(edge / F.pow(F.col("_unit"), level + 1))


def _meeting_tiles(boxes: DataFrame, iou: float, whole: str | None = None) -> DataFrame:
    """Copies of each box for every tile (``_at``) that may hold a box it competes with.

    A rival starts less than a tile before the box and not behind its end. Rows
    flagged by the column ``whole`` stand for their tile: they go wherever any box of
    it might, so that every tile it touches learns that more boxes follow.
    """
    steps = (-1, 0, 1) if iou > 0.05 else (0,)
    levels = F.explode(F.array(*[F.col("_level") + F.lit(step) for step in steps])).alias("_l")
    at = boxes.select("*", levels)
    for low, high, own, name in (("x1", "x2", "_tx", "_x"), ("y1", "y2", "_ty", "_y")):
        first, last = F.col(low), F.col(high)
        if whole is not None:
            width = F.pow(F.col("_unit"), F.col("_level") + 1)
            first = F.when(F.col(whole), (F.col(own) - 0.01) * width).otherwise(first)
            last = F.when(F.col(whole), (F.col(own) + 2.01) * width).otherwise(last)
        span = F.sequence(_tile_of(first, F.col("_l")) - 1, _tile_of(last, F.col("_l")))
        at = at.select("*", F.explode(span).alias(name))
    place = F.struct(F.col("_l").alias("level"), F.col("_x").alias("tx"), F.col("_y").alias("ty"))
    return at.withColumn("_at", place).drop("_l", "_x", "_y")


def _iou_columns() -> Column:
    return F.coalesce(box_iou({c: F.col(f"u.{c}") for c in BOX}, {c: F.col(f"s._{c}") for c in BOX}), F.lit(0.0))


def _decider(iou: float, tile: list[str]):
    unknown, keep, drop = 0, 1, 2

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _ranked(pdf)
        boxes = pdf[BOX].to_numpy(dtype=float)
        own = pdf["_own"].to_numpy()
        cuts = np.flatnonzero(pdf["_cut"].to_numpy())
        seen = int(cuts[0]) + 1 if len(cuts) else len(pdf)  # below the first cut, better boxes may be hidden
        state = np.zeros(seen, dtype=int)
        for i in range(seen):
            meets = state[:i][_overlap(boxes[i], boxes[:i]) > iou]
            if (meets == keep).any():
                state[i] = drop
            elif own[i] and (meets == drop).all():
                state[i] = keep
        return pdf.iloc[:seen][state == keep][[*tile, "det_id"]]

    return decide


def detect_postprocess(detections: DataFrame, params: DetectParams = DetectParams(), by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Frame stride, confidence and classes, suppression, then the limit per image."""
    strided = frame_stride(detections, params.vid_stride)
    chosen = filter_detections(strided, params.conf, params.classes)
    return max_det(nms(chosen, params.iou, params.agnostic, by), params.max_det, by)


def label_lines(detections: DataFrame, width: float, height: float, save_conf: bool = False) -> DataFrame:
    """(image_id, det_id, line): class, centre and size as shares of the frame, optionally confidence."""

    def number(value: Column) -> Column:
        return F.format_string("%.6f", value)

    parts = [
        F.col("class_id").cast("string"),
        number((F.col("x1") + F.col("x2")) / 2 / width),
        number((F.col("y1") + F.col("y2")) / 2 / height),
        number((F.col("x2") - F.col("x1")) / width),
        number((F.col("y2") - F.col("y1")) / height),
    ]
    if save_conf:
        parts.append(number(F.col("conf")))
    return detections.select("image_id", "det_id", F.concat_ws(" ", *parts).alias("line"))


def write_detections(
    detections: DataFrame, folder: str, width: float, height: float, save_conf: bool = False, files: Files | None = None
) -> DataFrame:
    """One file of label lines per image at ``<folder>/<image_id>.txt``, in order of det_id; returns a status row per file.

    ``folder`` may be in any store. The files are there when this returns; reading the status writes nothing.
    """
    lines = label_lines(detections, width, height, save_conf)
    path = F.concat(F.lit(f"{folder}/"), "image_id", F.lit(".txt"))
    return write_named(lines.select("line", "det_id", path.alias("out_path")), folder, ("det_id", "line"), ["line"], files)
