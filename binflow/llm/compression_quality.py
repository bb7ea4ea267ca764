"""Quality classifier: which of two zstandard dictionaries, of good or bad text, fits a text better."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binflow.llm.common import held_out
from binflow.session import materialize

#: Labelled documents of each class that the fit reads, at most: half for the dictionary, half to calibrate.
PER_CLASS = 1200
#: Blocks of a document that may go into a dictionary, spread over its whole length.
BLOCKS_PER_DOC = 6
#: Bytes of a block; each is compressed on its own, so a long text does not become its own dictionary.
BLOCK = 1024
DICT_BYTES = 110 * 1024
LEVEL = 3
#: Bytes at which a text counts as half short.
SHORT = 128.0


def blocks_of(text: str | None) -> list[bytes]:
    """All of a text in blocks of about BLOCK bytes; none for NULL or empty text."""
    raw = text.encode("utf-8", "replace") if text else b""
    n = max(1, round(len(raw) / BLOCK))
    size = -(-len(raw) // n)
    return [raw[i : i + size] for i in range(0, len(raw), size)] if raw else []


def build_dictionary(samples: list[bytes]) -> bytes:
    """Dictionary of at most DICT_BYTES; the samples themselves where they are too few to train one."""
    total = sum(map(len, samples))
    if len(samples) >= 50 and total >= 4 * DICT_BYTES:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    return b"".join(samples)[-DICT_BYTES:]


class Compressors:
    """Compressed sizes under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = self._one(good), self._one(bad)

    @staticmethod
    def _one(raw: bytes) -> zstandard.ZstdCompressor:
        if not raw:
            return zstandard.ZstdCompressor(level=LEVEL)
        kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        shared = zstandard.ZstdCompressionDict(raw, dict_type=kind)
        shared.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)

    def difference(self, text: str | None) -> tuple[float, float]:
        """(size under bad - size under good) / their mean, over the blocks of the whole text, 0 without text;
        and how short the text is, 1 without text: in a short one the difference says less."""
        good = bad = 0
        for block in blocks_of(text):
            good += len(self.good.compress(block))
            bad += len(self.bad.compress(block))
        short = SHORT / (SHORT + (len(text.encode("utf-8", "replace")) if text else 0))
        return (2.0 * (bad - good) / (bad + good) if good + bad else 0.0), short


def fit_logistic(x: np.ndarray, y: np.ndarray, odds: float) -> np.ndarray:
    """Weights, the intercept last, of P(y = 1) by Newton steps with a slight ridge; moved from the sample's odds to ``odds``."""
    w = np.zeros(x.shape[1] + 1)
    if len(x) == 0 or y.min() == y.max():
        w[-1] = np.log(odds)
        return w
    scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    z = np.column_stack([x / scale, np.ones(len(x))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w))
        w = w + np.linalg.solve(hess, z.T @ (y - p) - 1e-2 * w)
    share = y.mean()
    w[-1] += np.log(odds) - np.log(share / (1 - share))
    w[:-1] /= scale
    return w


def _sample_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        quality, found = [], []
        for q, t in zip(batch.column(0), batch.column(1)):
            blocks = blocks_of(t.as_py())
            for i in sorted({i * len(blocks) // BLOCKS_PER_DOC for i in range(BLOCKS_PER_DOC)} if blocks else ()):
                quality.append(q.as_py())
                found.append(blocks[i])
        yield pa.RecordBatch.from_arrays([pa.array(quality, pa.int32()), pa.array(found, pa.binary())], ["quality", "block"])


def _differences(shared):
    """Rows (key, text) to (key, x, short)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Compressors(*shared.value)
        for batch in batches:
            found = [both.difference(t.as_py()) for t in batch.column(1)]
            columns = [pa.array([f[i] for f in found], pa.float64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", "x", "short"])

    return run


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.7,
    per_class: int = PER_CLASS,
) -> DataFrame:
    """Quality of each document: id, ``held_out``, ``score`` (0 to 1), ``predicted`` and ``difference``.

    Labels are learned from documents outside the held-out fold (crc32 of the id
    modulo 4 is 2). Of each class at most ``per_class`` documents, the first by a
    hash of the id, are read for the fit: blocks of one half build the class's
    dictionary, whole texts of the other calibrate the score, a logistic curve
    of the normalised difference of compressed sizes and of how short the text is. The class shares of all
    learned labels set its level. Every document is scored over its whole text,
    by its text alone.

    A NULL or empty text has difference 0, as a text that both fit equally. A NULL
    id is not held out. Labels that are NULL, other than 0 and 1, or that
    contradict each other for an id are not learned. Repeated rows get equal
    scores. Without labels of both classes the score is their share (0.5 without
    any). Other columns are not read. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("quality"))
    known = known.where(F.col("quality").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    known = materialize(
        known.groupBy("id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_q")).where(F.col("quality") == F.col("_q")).drop("_q")
    )
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64(F.lit(2), "id")
    chosen = None
    for q in (0, 1):
        some = known.where(F.col("quality") == q).orderBy(order, "id").limit(per_class)
        chosen = some if chosen is None else chosen.union(some)
    chosen = F.broadcast(materialize(chosen))  # at most 2 * per_class rows
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # One row per id is enough to learn from.
    sample = materialize(rows.join(chosen, "id").groupBy("id", "quality").agg(F.min("text").alias("text")))
    first = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(2)) == 0
    blocks = sample.where(first).orderBy("id").select("quality", "text").mapInArrow(_sample_blocks, "quality int, block binary").toArrow()
    parts: dict[int, list[bytes]] = {0: [], 1: []}
    for q, block in zip(blocks.column("quality"), blocks.column("block")):
        parts[q.as_py()].append(block.as_py())
    shared = spark.sparkContext.broadcast((build_dictionary(parts[1]), build_dictionary(parts[0])))
    tuned = sample.where(~first).select(F.col("quality").alias("key"), "text").mapInArrow(_differences(shared), "key int, x double, short double").toArrow()
    odds = (counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5)
    seen = np.column_stack([tuned.column("x").to_numpy(), tuned.column("short").to_numpy()])
    slope, shift, level = map(float, fit_logistic(seen, tuned.column("key").to_numpy().astype(float), odds))
    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.select(F.col("id").alias("key"), "text").mapInArrow(_differences(shared), f"key {kind}, x double, short double")
    score = 1.0 / (1.0 + F.exp(-(F.lit(slope) * F.col("x") + F.lit(shift) * F.col("short") + F.lit(level))))
    return scored.select(
        F.col("key").alias(id_col), held_out(F.col("key")).alias("held_out"), score.alias("score"),
        F.when(score >= threshold, 1).otherwise(0).alias("predicted"), F.col("x").alias("difference"),
    )
