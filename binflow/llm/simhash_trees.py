"""SimHash near-dedup: fingerprints within two bits, found by BK-trees of bounded shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binflow.llm.hashing import rows_of
from binflow.llm.ngram_join import connected
from binflow.session import materialize

SHINGLE, RADIUS = 3, 2
SEED = 42
BITS = 64
#: Most fingerprints of a shard. Masks are refined until fewer bits are left open than would hold more.
SHARD = 2048
#: Shingles whose bits are counted at once.
STEP = 16_384


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit k is set where more than half of the shingles' XXH64 have it; 0 without words."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    n = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    spans = zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist())
    count = len(words) - n + 1
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, count)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, count, STEP):
        part = hashes[i : i + STEP].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t, shingle) for (t,) in rows_of(iter([batch]), "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64))], ["id", "fp"])

    return run


class BKTree:
    """Numbers by Hamming distance: the children of a node are keyed by their distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        """Insert a number; one that is there already changes nothing."""
        at = 0
        while self.values:
            distance = (value ^ self.values[at]).bit_count()
            if distance == 0:
                return
            following = self.children[at].get(distance)
            if following is None:
                self.children[at][distance] = len(self.values)
                break
            at = following
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Numbers at most ``radius`` bits away: only edges whose distance is within the radius of the node's own can lead there."""
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            distance = (value ^ self.values[at]).bit_count()
            if distance <= radius:
                yield self.values[at]
            edges = self.children[at]
            for edge in range(max(1, distance - radius), distance + radius + 1):
                if edge in edges:
                    todo.append(edges[edge])


def shard_links(values: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links that connect what the numbers within the radius of each other connect: (number, least number of its group)."""
    tree, group = BKTree(), {v: v for v in values}

    def root(v: int) -> int:
        while group[v] != v:
            group[v] = group[group[v]]
            v = group[v]
        return v

    for v in values:
        for near in tree.within(v, radius):
            a, b = sorted((root(v), root(near)))
            group[b] = a
        tree.add(v)
    for v in values:
        if (r := root(v)) != v:
            yield v, r


def _search(radius: int):
    """Rows (fps: array) to links (a, b) of fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0)
            ends = fps.offsets.to_numpy()
            flat = fps.values.to_numpy().view(np.uint64)
            links = []
            for start, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
                links.extend(shard_links(np.sort(flat[start:end]).tolist(), radius))
            both = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])

    return run


def refine(mask: int, radius: int) -> list[int]:
    """The mask with one of ``radius + 1`` slices of its open bits added, for each slice.

    Two numbers that agree on the mask and differ in at most ``radius`` bits agree on all of one slice.
    """
    open_bits = [i for i in range(BITS) if not mask >> i & 1]
    parts = radius + 1
    cuts = [len(open_bits) * i // parts for i in range(parts + 1)]
    return [mask | sum(1 << i for i in open_bits[a:b]) for a, b in zip(cuts, cuts[1:])]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def links_within(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` at most ``radius`` bits apart.

    A shard is a mask and the value of its bits. Near fingerprints share a shard of one of the first masks. A shard
    of more than ``shard`` fingerprints is dealt anew under masks with more bits, and so on: with fewer open
    bits than ``log2(shard)`` it cannot be too large, so the rounds end and no shard is ever gathered that exceeds the bound. A
    fingerprint is in ``radius + 1`` shards, and in as many more for each of its shards that was too large.
    """
    if shard < 2:
        raise ValueError("a shard holds two fingerprints at least")
    first = [F.lit(signed(m)) for m in refine(0, radius)]
    rows = fps.select("fp", F.explode(F.array(*first)).alias("mask"))
    found = None
    while True:
        keyed = rows.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"))
        sizes = materialize(keyed.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))
        fitting = keyed.join(sizes.where(F.col("n") <= shard), ["mask", "value"])
        shards = fitting.groupBy("mask", "value").agg(F.collect_list("fp").alias("fps")).select("fps")
        links = materialize(shards.mapInArrow(_search(radius), "a long, b long"))
        found = links if found is None else found.unionByName(links)
        large = sizes.where(F.col("n") > shard)
        if large.isEmpty():
            return found
        # Masks, not fingerprints: at most radius + 1 times as many a round, whatever the table holds.
        masks = [r.mask for r in large.select("mask").distinct().collect()]
        finer = [(m, [signed(k) for k in refine(m % (1 << BITS), radius)]) for m in masks]
        finer = F.broadcast(fps.sparkSession.createDataFrame(finer, "mask long, finer array<long>"))
        again = keyed.join(large, ["mask", "value"], "left_semi").join(finer, "mask")
        rows = materialize(again.select("fp", F.explode("finer").alias("mask")))


def near_fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, shard: int = SHARD
) -> DataFrame:
    """Components of documents whose SimHash fingerprints differ in at most ``radius`` bits.

    Words are runs without blanks, A-Z lower-cased; shingles of ``shingle`` words joined by spaces, repeats included, are hashed by
    XXH64 (seed 42). A text of fewer words is one shingle. A NULL or empty text has the fingerprint zero and is
    linked like any other. Returns one row per row of ``docs``: the id, ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest id that links reach. A row without an id has a fingerprint, links nothing and has
    a NULL component. Repeated rows and rows of one id stay rows of their own. Other columns are not read. An empty table
    gives an empty table.

    Each distinct fingerprint is searched once (:func:`links_within`), so copies cost no comparison; a BK-tree
    is built in the task that holds a shard and asked there for each of its members.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    described = materialize(rows.mapInArrow(_fingerprints(shingle), f"id {id_type}, fp long"))
    named = described.where(F.col("id").isNotNull())
    least = materialize(named.groupBy("fp").agg(F.min("id").alias("least")))
    labels = connected(links_within(least.select("fp"), radius, shard))
    of = least.join(labels, least["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    smallest = of.groupBy("label").agg(F.min("least").alias("component_id"))
    of = materialize(of.join(smallest, "label").select("fp", "component_id"))
    own = F.when(F.col("id").isNotNull(), F.col("component_id"))
    digits = F.lower(F.lpad(F.hex("fp"), BITS // 4, "0"))
    return described.join(of, "fp", "left").select(F.col("id").alias(id_col), digits.alias("fingerprint"), own.alias("component_id"))
