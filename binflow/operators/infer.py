"""Batched model inference and feature extraction on particle images."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binflow.functions import numeric
from binflow.operators.select import select_units

KEYS = ["sample_id", "roi_number"]


def model_infer(
    df: DataFrame,
    make_predict_fn: Callable,
    column: str,
    shape: list[int],
    batch: int = 64,
    embeddings: bool = False,
    embeddings_only: bool = False,
    ensure_softmax: bool = True,
) -> DataFrame:
    """Adds ``scores`` and, if asked for, ``embedding`` from a caller's model.

    ``make_predict_fn`` loads the model once per Python worker and returns a
    function from a batch of inputs to {"scores": ..., "embedding": ...}. The
    embedding needs a model with a second output.
    """
    wanted = {"scores": not embeddings_only, "embedding": embeddings or embeddings_only}
    vector = T.ArrayType(T.DoubleType())
    result = T.StructType([T.StructField(name, vector) for name, on in wanted.items() if on])

    def make_wanted():
        run = make_predict_fn()

        def predict(inputs: np.ndarray) -> dict[str, np.ndarray]:
            out = run(inputs)
            return {name: out[name] for name, on in wanted.items() if on}

        return predict

    predict = predict_batch_udf(make_wanted, return_type=result, batch_size=batch, input_tensor_shapes=[shape])
    kept = [c for c in df.columns if c != column]
    out = df.select(*kept, predict(column).alias("_out"))
    columns: list[Column] = []
    if wanted["scores"]:
        scores = F.col("_out.scores")
        columns.append((numeric.softmax(scores) if ensure_softmax else scores).alias("scores"))
    if wanted["embedding"]:
        columns.append(F.col("_out.embedding").alias("embedding"))
    return out.select(*kept, *columns)


def onnx_predict_fn(model: bytes) -> Callable:
    """``make_predict_fn`` for a serialized ONNX model with one or two outputs."""

    def make():
        import onnxruntime

        session = onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"])
        source = session.get_inputs()[0].name
        names = ["scores", "embedding"][: len(session.get_outputs())]

        def predict(inputs: np.ndarray) -> dict[str, np.ndarray]:
            return dict(zip(names, session.run(None, {source: inputs.astype(np.float32)})))

        return predict

    return make


def label_classes(scores: DataFrame, classes: DataFrame, column: str = "scores") -> DataFrame:
    """One row per class with its name, NULL where it has none; the index is the line of the class file from 0."""
    kept = [c for c in scores.columns if c != column]
    long = scores.select(*kept, F.posexplode(column).alias("class_id", "score"))
    return long.join(classes.select("class_id", "name"), "class_id", "left")


def top_classes(scores: DataFrame, classes: DataFrame, column: str = "scores") -> DataFrame:
    """Best class of each row with its name and score."""
    kept = [c for c in scores.columns if c != column]
    best = scores.select(*kept, numeric.top_class(F.col(column)).alias("class_id"), F.array_max(column).alias("score"))
    return best.join(classes.select("class_id", "name"), "class_id", "left")


def roi_features(rois: DataFrame) -> DataFrame:
    """Area, bounding box, centroid and fill of each mask; NULL geometry for an empty mask.

    Masks are row-major arrays with a width. All work stays on arrays in one row.
    """
    cells = F.filter(F.sequence(F.lit(0), F.size("mask") - 1), lambda i: F.get("mask", i).cast("boolean"))
    placed = rois.withColumn("_on", F.when(F.size("mask") > 0, cells).otherwise(F.array().cast("array<int>")))
    xs = placed.withColumn("_x", F.transform("_on", lambda i: i % F.col("width"))).withColumn(
        "_y", F.transform("_on", lambda i: F.floor(i / F.col("width")).cast("int"))
    )

    def mean(values: str) -> Column:
        return F.try_divide(F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, v: acc + v), F.size(values))

    area = F.size("_on")
    box = (F.array_max("_x") - F.array_min("_x") + 1) * (F.array_max("_y") - F.array_min("_y") + 1)
    return xs.select(
        *KEYS,
        area.alias("area"),
        F.array_min("_x").alias("x_min"),
        F.array_min("_y").alias("y_min"),
        F.array_max("_x").alias("x_max"),
        F.array_max("_y").alias("y_max"),
        mean("_x").alias("centroid_x"),
        mean("_y").alias("centroid_y"),
        F.try_divide(area, box).alias("fill"),
    )


BLOB_SCHEMA = "sample_id string, roi_number bigint, blob int, area int, x_min int, y_min int, x_max int, y_max int"


def roi_blobs(rois: DataFrame) -> DataFrame:
    """One row per blob: the 8-connected parts of a mask, numbered by their first pixel."""
    return map_rois(rois, _blob_batch, BLOB_SCHEMA)


def _blob_batch(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows of BLOB_SCHEMA; a mask that is missing or empty has none."""
    names = [c.split()[0] for c in BLOB_SCHEMA.split(", ")]
    found = [pd.DataFrame({c: pd.Series(dtype="object" if c == "sample_id" else "int64") for c in names})]
    for sample, roi, width, mask in pdf[[*KEYS, "width", "mask"]].itertuples(index=False):
        if mask is None or len(mask) == 0:
            continue
        blobs = _blobs(np.asarray(mask, dtype=bool).reshape(-1, int(width)))
        count = len(blobs[0])
        found.append(pd.DataFrame(dict(zip(names, [[sample] * count, [roi] * count, np.arange(count), *blobs]))))
    return pd.concat(found, ignore_index=True)


def _blobs(grid: np.ndarray) -> tuple[np.ndarray, ...]:
    """Area, x_min, y_min, x_max, y_max of the 8-connected parts, in the order of their first pixels.

    Works on runs, the unbroken stretches of a row, all at once: runs of neighbouring rows that touch are found
    by binary search and joined by hooking the later of two groups to the earlier and halving the ways, until nothing changes.
    """
    width = grid.shape[1] + 2
    steps = np.diff(np.pad(grid, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    ys, starts = np.nonzero(steps == 1)
    ends = np.nonzero(steps == -1)[1]  # first pixel after the run
    above = (ys - 1) * width
    first = np.searchsorted(ys * width + ends, above + starts)
    touching = np.maximum(np.searchsorted(ys * width + starts, above + ends, side="right") - first, 0)
    here = np.repeat(np.arange(len(ys)), touching)
    there = np.arange(len(here)) - np.repeat(np.cumsum(touching) - touching, touching) + np.repeat(first, touching)
    group = np.arange(len(ys))
    while True:
        a, b = group[here], group[there]
        if np.array_equal(a, b):
            break
        np.minimum.at(group, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(group, group[group]):
            group = group[group]
    # The earliest run of a part names it, and runs are in the order of their pixels.
    part = np.unique(group, return_inverse=True)[1]
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
    if not len(cuts):
        return (np.zeros(0, np.int64),) * 5
    over = lambda f, values: f.reduceat(values[order], cuts)
    area = over(np.add, ends - starts)
    return area, over(np.minimum, starts), over(np.minimum, ys), over(np.maximum, ends - 1), over(np.maximum, ys)


def map_rois(
    rois: DataFrame,
    extractor: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    bins: DataFrame | list[str] | None = None,
    min_batch: int = 4,
    max_batch: int = 64,
) -> DataFrame:
    """Rows a caller's extractor gives for batches of particle images, for all or the listed samples.

    Batches hold ``max_batch`` rows. A last batch below ``min_batch`` rows is not
    worth a batch and goes row by row.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for start in range(0, len(pdf), max_batch):
                batch = pdf.iloc[start : start + max_batch]
                pieces = [batch] if len(batch) >= min_batch else [batch.iloc[i : i + 1] for i in range(len(batch))]
                for piece in pieces:
                    yield extractor(piece)

    return select_units(rois, bins, "sample_id").mapInPandas(run, schema)
