"""Isolation forest over per-bin features (Liu, Ting and Zhou, ICDM 2008).

Trees grow on hash-chosen samples, so a forest depends on the rows and the seed
but not on their partitioning. A missing value always goes to the left.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from binflow.functions.scale import TASK_ROWS, exact_quantiles, hot_keys, number_rows
from binflow.operators.select import filter_bin_type
from binflow.params import ForestParams, ValueRange
from binflow.session import materialize
from binflow.sources.scores import merge_scores

NODE_SCHEMA = (
    "combo_id int, tree_id int, node_id bigint, feature string, threshold double, "
    "`left` bigint, `right` bigint, size bigint"
)
#: Most nodes that scoring may broadcast; a larger forest is scored in slices of trees.
BROADCAST_NODES = 5_000_000


@dataclass
class Forest:
    """Node table plus what scoring has to know about it."""

    nodes: DataFrame
    feature_names: tuple[str, ...]
    psi: int
    trees: int
    combo_id: int = 0

    def small(self, most: int) -> pd.DataFrame | None:
        """The node table if it has at most ``most`` nodes, kept after the first call."""
        if not hasattr(self, "_small"):
            head = self.nodes.drop("combo_id").limit(most + 1).toPandas()
            self._small = head if len(head) <= most else None
        return self._small

    def slices(self, most: int) -> tuple[list[list[int]], list[int]]:
        """Tree numbers in runs of at most ``most`` nodes, and the trees that have more alone."""
        runs: list[list[int]] = []
        large: list[int] = []
        held = most
        for r in self.nodes.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n")).orderBy("tree_id").collect():
            if r.n > most:
                large.append(r.tree_id)
                continue
            if held + r.n > most:
                runs.append([])
                held = 0
            runs[-1].append(r.tree_id)
            held += r.n
        return runs, large

    def save(self, path: str) -> None:
        spark = self.nodes.sparkSession
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        meta = spark.createDataFrame(
            [(list(self.feature_names), self.psi, self.trees, self.combo_id)],
            "feature_names array<string>, psi bigint, trees int, combo_id int",
        )
        meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Forest:
        meta = spark.read.parquet(f"{path}/meta").first()
        return Forest(
            spark.read.parquet(f"{path}/nodes"), tuple(meta.feature_names), meta.psi, meta.trees, meta.combo_id
        )


def average_path(size: float) -> float:
    """Mean path length of an unsuccessful search among ``size`` rows."""
    if size <= 1:
        return 0.0
    if size == 2:
        return 1.0
    return 2.0 * (math.log(size - 1) + 0.5772156649) - 2.0 * (size - 1) / size


@dataclass(frozen=True)
class _Spec:
    """What the trees of one or more parameter combinations share."""

    combo_id: int
    psi: int
    features: int
    trees: int
    seed: int

    @property
    def depth(self) -> int:
        return math.ceil(math.log2(max(self.psi, 2)))

    def subset(self, tree: int, available: int) -> np.ndarray:
        rng = np.random.default_rng([self.seed, self.combo_id, tree])
        return np.sort(rng.choice(available, size=self.features, replace=False))


def _samples(features: DataFrame, names: list[str], specs: list[_Spec], rows: int, task_rows: int) -> DataFrame:
    """(combo_id, tree_id, node_id, bin_id, f): exactly psi rows per tree, or all if fewer.

    A hash threshold leaves slightly more than psi candidates per tree in the
    map stage; only those are shuffled and cut to the psi smallest hashes.
    """
    values = F.array(*[F.round(F.col(n).cast("double"), 9) for n in names])
    packed = features.select("bin_id", values.alias("f"))
    parts = []
    for spec in specs:
        share = min(1.0, (spec.psi + 8 * math.sqrt(spec.psi) + 8) / rows)
        tree = F.explode(F.sequence(F.lit(0), F.lit(spec.trees - 1))).alias("tree_id")
        h = F.xxhash64("bin_id", "tree_id", F.lit(spec.seed), F.lit(spec.combo_id))
        chosen = (
            packed.select("bin_id", "f", tree)
            .withColumn("_h", h)
            .filter((F.lit(share) >= 1.0) | (F.pmod("_h", F.lit(1 << 40)) < int(share * (1 << 40))))
        )
        parts.append(chosen.withColumn("combo_id", F.lit(spec.combo_id)).withColumn("_psi", F.lit(spec.psi)))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    if all(spec.psi >= rows for spec in specs):
        kept = union
    elif max(spec.psi for spec in specs) > task_rows:
        kept = number_rows(union, ["_h", "bin_id"], ["combo_id", "tree_id"], "_r").filter(F.col("_r") <= F.col("_psi"))
    else:
        order = Window.partitionBy("combo_id", "tree_id").orderBy("_h", "bin_id")
        kept = union.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= F.col("_psi"))
    return kept.select("combo_id", "tree_id", F.lit(1).cast("bigint").alias("node_id"), "bin_id", "f")


def _grower(specs: dict[int, _Spec], names: list[str]):
    """Function that grows the part of one tree below one node."""

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        combo, tree, root = (int(k) for k in key)
        spec = specs[combo]
        allowed = spec.subset(tree, len(names))
        pdf = pdf.sort_values("bin_id")
        x = np.array(pdf["f"].tolist(), dtype=float)
        rows = []
        open_nodes = [(root, np.arange(len(x)))]
        while open_nodes:
            node, member = open_nodes.pop()
            split = None
            if len(member) > 1 and node.bit_length() - 1 < spec.depth:
                split = _split(x[member][:, allowed], allowed, (spec.seed, combo, tree, node))
            if split is None:
                rows.append((combo, tree, node, None, None, None, None, len(member)))
                continue
            column, threshold = split
            right = x[member, column] >= threshold
            rows.append((combo, tree, node, names[column], threshold, 2 * node, 2 * node + 1, len(member)))
            open_nodes.append((2 * node, member[~right]))
            open_nodes.append((2 * node + 1, member[right]))
        out = pd.DataFrame(
            rows, columns=["combo_id", "tree_id", "node_id", "feature", "threshold", "left", "right", "size"]
        )
        return out.astype({"left": "Int64", "right": "Int64"})

    return grow


def _hashes(node: tuple[int, int, int, int], pos: int) -> tuple[int, int]:
    """Order of a feature and place of its threshold: Spark's ``xxhash64`` of (seed, combo, tree, node, pos), and of these and "at"."""
    h = 42
    for value, kind in zip((*node, pos), ("<i", "<i", "<i", "<q", "<i")):
        h = xxhash.xxh64_intdigest(struct.pack(kind, value), h)
    at = xxhash.xxh64_intdigest(b"at", h)
    return (h - (1 << 64) if h >> 63 else h), at


def _split(x: np.ndarray, allowed: np.ndarray, node: tuple[int, int, int, int]) -> tuple[int, float] | None:
    """Column and threshold of a node, by the rule of :func:`_split_large`."""
    known = np.where(np.isnan(x), np.inf, x).min(axis=0), np.where(np.isnan(x), -np.inf, x).max(axis=0)
    usable = np.flatnonzero(known[1] > known[0])
    if not len(usable):
        return None
    (_, at), pick = min((_hashes(node, int(allowed[i])), i) for i in usable)
    low, high = float(known[0][pick]), float(known[1][pick])
    threshold = low + (at % (1 << 40) + 1) / float((1 << 40) + 1) * (high - low)
    return int(allowed[pick]), threshold if threshold > low else high


def _split_large(sample: DataFrame, specs: dict[int, _Spec], names: list[str], task_rows: int):
    """Split tree nodes that are too large for one task, level by level.

    Each level is one partial aggregation for the ranges and one broadcast of the
    chosen splits. Returns the remaining sample and the finished nodes.
    """
    spark = sample.sparkSession
    key = ["combo_id", "tree_id", "node_id"]
    subset = [
        (s.combo_id, tree, int(pos)) for s in specs.values() for tree in range(s.trees) for pos in s.subset(tree, len(names))
    ]
    allowed = F.broadcast(spark.createDataFrame(subset, "combo_id int, tree_id int, pos int"))
    depth = F.broadcast(spark.createDataFrame([(s.combo_id, s.depth, s.seed) for s in specs.values()], "combo_id int, _depth int, _seed int"))
    finished = []
    while (hot := hot_keys(sample, key, task_rows)) is not None:
        large = sample.join(hot, key, "left_semi")
        known = F.when(~F.isnan("v"), F.col("v"))  # missing values are NULL or NaN
        ranges = (
            large.select(*key, F.posexplode("f").alias("pos", "v"))
            .join(allowed, ["combo_id", "tree_id", "pos"])
            .groupBy(*key, "pos")
            .agg(F.count(F.lit(1)).alias("size"), F.min(known).alias("_lo"), F.max(known).alias("_hi"))
            .join(depth, "combo_id")
        )
        open_level = F.length(F.bin("node_id")) - 1 < F.col("_depth")
        usable = open_level & (F.col("_hi") > F.col("_lo"))
        turn = F.xxhash64("_seed", *key, "pos")
        unit = (F.pmod(F.xxhash64("_seed", *key, "pos", F.lit("at")), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
        inner = F.col("_lo") + unit * (F.col("_hi") - F.col("_lo"))
        threshold = F.when(inner > F.col("_lo"), inner).otherwise(F.col("_hi"))
        best = F.min(F.when(usable, F.struct(turn.alias("h"), "pos", threshold.alias("t"))))
        splits = ranges.groupBy(*key).agg(best.alias("s"), F.max("size").alias("size"))
        name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("s.pos") + 1)
        child = F.when(F.col("s").isNotNull(), 2 * F.col("node_id"))
        splits = materialize(splits.withColumn("feature", F.when(F.col("s").isNotNull(), name)))
        finished.append(
            splits.select(
                *key, "feature", F.col("s.t").alias("threshold"), child.alias("left"), (child + 1).alias("right"), "size"
            )
        )
        # One row per hot node, so the broadcast is bounded. Leaves drop out here.
        moves = F.broadcast(splits.filter("s is not null").select(*key, "s.pos", "s.t"))
        goes_right = F.coalesce(~F.isnan(F.get("f", "pos")) & (F.get("f", "pos") >= F.col("t")), F.lit(False)).cast("bigint")
        moved = large.join(moves, key).select(
            "combo_id", "tree_id", (2 * F.col("node_id") + goes_right).alias("node_id"), "bin_id", "f"
        )
        sample = materialize(sample.join(hot, key, "left_anti").unionByName(moved))
    return sample, finished


def _grow(features: DataFrame, names: list[str], specs: list[_Spec], rows: int, task_rows: int) -> DataFrame:
    table = {s.combo_id: s for s in specs}
    sample = _samples(features, names, specs, rows, task_rows)
    finished: list[DataFrame] = []
    if max(s.psi for s in specs) > task_rows:
        sample, finished = _split_large(materialize(sample), table, names, task_rows)
    # A set number of partitions: growing is Python work, so small bytes must not mean one task.
    parts = int(sample.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["combo_id", "tree_id", "node_id"]
    grown = sample.repartition(parts, *key).groupBy(*key).applyInPandas(_grower(table, names), NODE_SCHEMA)
    for part in finished:
        grown = grown.unionByName(part)
    return grown


def train_forest(
    features: DataFrame, params: ForestParams = ForestParams(), names: list[str] | None = None, task_rows: int = TASK_ROWS
) -> Forest:
    """Grow a forest on all feature columns, or on the named ones.

    The nodes are written as a table: scoring reads them more than once.
    """
    names = sorted(names or [c for c in features.columns if c != "bin_id"])
    rows = features.count()
    if not rows:
        raise ValueError("no rows to train on")
    spec = _Spec(0, params.sample_size(rows), params.feature_count(len(names)), params.trees, params.seed)
    nodes = materialize(_grow(features, names, [spec], rows, task_rows))
    return Forest(nodes, tuple(names), spec.psi, spec.trees)


@dataclass
class _Packed:
    """A node table as arrays, built once on the driver: tasks only look things up."""

    left: np.ndarray
    right: np.ndarray
    column: np.ndarray
    threshold: np.ndarray
    length: np.ndarray
    roots: np.ndarray
    levels: int


def _pack(nodes: pd.DataFrame, names: list[str]) -> _Packed:
    """Arrays of a node table whose features are columns of a matrix in the order of ``names``."""
    nodes = nodes.sort_values(["tree_id", "node_id"], ignore_index=True)
    place = pd.MultiIndex.from_arrays([nodes["tree_id"], nodes["node_id"]])
    leaf = nodes["feature"].isna().to_numpy()
    here = np.arange(len(nodes))

    def child(column: str) -> np.ndarray:
        ids = nodes[column].fillna(0).astype("int64")
        return np.where(leaf, here, place.get_indexer(pd.MultiIndex.from_arrays([nodes["tree_id"], ids])))

    column = np.where(leaf, 0, pd.Index(names).get_indexer(nodes["feature"].fillna(names[0] if names else "")))
    level = np.floor(np.log2(nodes["node_id"].to_numpy(dtype=float))).astype(np.int64) if len(nodes) else here
    sizes = nodes["size"].to_numpy()
    distinct, which = np.unique(sizes, return_inverse=True)
    length = level + np.array([average_path(s) for s in distinct])[which] if len(nodes) else np.zeros(0)
    roots = np.flatnonzero(nodes["node_id"].to_numpy() == 1)
    threshold = nodes["threshold"].to_numpy(dtype=float, na_value=np.nan)
    return _Packed(child("left"), child("right"), column, threshold, length, roots, int(level.max(initial=0)))


def _total_path(packed: _Packed, x: np.ndarray) -> np.ndarray:
    """Path lengths of the rows of a feature matrix, summed over the trees."""
    at = np.tile(packed.roots, (len(x), 1))
    row = np.arange(len(x))[:, None]
    for _ in range(packed.levels):
        goes_right = x[row, packed.column[at]] >= packed.threshold[at]
        at = np.where(goes_right, packed.right[at], packed.left[at])
    return packed.length[at].sum(axis=1)


def score_forest(features: DataFrame, forest: Forest, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """(bin_id, score): 2 ** (-mean path / c(psi)); higher is more abnormal.

    Features are matched by name; a missing one is an error. The node table is
    broadcast while it is small. A larger forest is cut into slices of trees: the rows
    pass one slice after the other, written in between, and carry the sum of their
    path lengths, so every row has its own score, also where identifiers repeat. Trees that
    are too large alone are walked by joins (:func:`_add_walked`).
    """
    nodes = forest.small(broadcast_nodes)
    if nodes is not None:
        return _score_small(features, {"": (forest, nodes)})
    rows = _rounded(features, forest.feature_names).withColumn("_paths", F.lit(0.0))
    runs, large = forest.slices(broadcast_nodes)
    table = forest.nodes.drop("combo_id")
    for run in runs:
        part = table.filter(F.col("tree_id").isin(run)).toPandas()
        rows = materialize(_add_paths(rows, part, list(forest.feature_names)))
    if large:
        rows = _add_walked(rows, table.filter(F.col("tree_id").isin(large)), list(forest.feature_names), broadcast_nodes)
    scale = forest.trees * average_path(forest.psi)
    return rows.select("bin_id", F.pow(F.lit(2.0), -F.col("_paths") / F.lit(scale)).alias("score"))


def _rounded(features: DataFrame, names: tuple[str, ...] | list[str]) -> DataFrame:
    absent = [n for n in names if n not in features.columns]
    if absent:
        raise ValueError(f"features are missing: {absent}")
    return features.select("bin_id", *[F.round(F.col(n).cast("double"), 9).alias(n) for n in names])


def _add_paths(rows: DataFrame, nodes: pd.DataFrame, names: list[str]) -> DataFrame:
    """The rows with the path lengths over the given trees added to ``_paths``."""
    shared = rows.sparkSession.sparkContext.broadcast(_pack(nodes, names))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = pdf[names].to_numpy(dtype=float, na_value=np.nan)
                yield pdf.assign(_paths=pdf["_paths"] + _total_path(shared.value, x))

    return rows.mapInPandas(add, rows.schema)


def _average_path(size: Column) -> Column:
    """:func:`average_path` of a column."""
    n = size.cast("double")
    return F.when(size <= 1, 0.0).when(size == 2, 1.0).otherwise(2.0 * (F.ln(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n)


#: Levels that rows go down before they are written.
LEVELS_A_WRITE = 6


def _add_walked(rows: DataFrame, nodes: DataFrame, names: list[str], broadcast_nodes: int) -> DataFrame:
    """The rows with the path lengths over the given trees added to ``_paths``; no tree is held anywhere as a whole.

    The frontier, one row per row and tree, goes down a level by a join with the nodes of that level. Levels of few nodes are
    broadcast, so the shuffles begin where a tree is wide and the frontier spread; a node that holds most rows is a key that
    Spark may split, as both sides are plain exchanges.
    """
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()))
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("feature")) - 1
    level_of = F.length(F.bin("node_id")) - 1
    nodes = materialize(
        nodes.select(
            "tree_id", "node_id", level_of.alias("_level"), F.col("feature").isNull().alias("_leaf"), place.cast("int").alias("_pos"),
            "threshold", (level_of + _average_path(F.col("size"))).alias("_whole"),
        )
    )
    sizes = {r["_level"]: r["n"] for r in nodes.groupBy("_level").agg(F.count(F.lit(1)).alias("n")).collect()}
    trees = nodes.where("_level = 0").select("tree_id")
    at = F.array(*[F.col(n) for n in names])
    roots = trees.withColumn("_one", F.lit(1))
    front = rows.select("_row", at.alias("f"), F.lit(1).alias("_one")).join(F.broadcast(roots), "_one").drop("_one")
    front = front.select("_row", "f", "tree_id", F.lit(1).cast("bigint").alias("node_id"), F.lit(None).cast("double").alias("_length"))
    for level in range(max(sizes) + 1):
        here = nodes.where(F.col("_level") == level).drop("_level")
        if sizes[level] <= broadcast_nodes:
            here = F.broadcast(here)
        value = F.get("f", "_pos")
        right = F.coalesce(~F.isnan(value) & (value >= F.col("threshold")), F.lit(False)).cast("bigint")
        inner = F.col("_leaf").isNotNull() & ~F.col("_leaf")
        front = front.join(here, ["tree_id", "node_id"], "left").select(
            "_row", "f", "tree_id", F.when(inner, 2 * F.col("node_id") + right).otherwise(F.col("node_id")).alias("node_id"),
            F.when(F.col("_leaf"), F.col("_whole")).otherwise(F.col("_length")).alias("_length"),
        )
        if level % LEVELS_A_WRITE == LEVELS_A_WRITE - 1:
            front = materialize(front)
    walked = front.groupBy("_row").agg(F.sum("_length").alias("_walked"))
    return rows.join(walked, "_row").withColumn("_paths", F.col("_paths") + F.col("_walked")).drop("_row", "_walked")


def _score_small(features: DataFrame, forests: dict[str, tuple[Forest, pd.DataFrame]]) -> DataFrame:
    """Score in one pass; a bin uses the forest whose key starts its identifier."""
    used = sorted({n for forest, _ in forests.values() for n in forest.feature_names})
    rows = _rounded(features, used)
    context = features.sparkSession.sparkContext
    shared = {
        prefix: (context.broadcast(_pack(nodes, list(f.feature_names))), list(f.feature_names), f.trees * average_path(f.psi))
        for prefix, (f, nodes) in forests.items()
    }

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for prefix, (packed, names, scale) in shared.items():
                mine = pdf[pdf["bin_id"].str.startswith(prefix)]
                if len(mine):
                    paths = _total_path(packed.value, mine[names].to_numpy(dtype=float, na_value=np.nan))
                    yield pd.DataFrame({"bin_id": mine["bin_id"], "score": 2.0 ** (-paths / scale)})

    return rows.mapInPandas(score, "bin_id string, score double")


def score_forests(features: DataFrame, forests: list[Forest], broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """(forest_id, bin_id, score) of every row under every forest; ``forest_id`` is the forest's combo_id.

    Forests that together have at most ``broadcast_nodes`` nodes score in one pass over the rows, so a grid of usual size
    is one scan and one stage. A forest that is too large alone is scored in slices.
    """
    passes: list[list[tuple[Forest, pd.DataFrame]]] = []
    held, parts = broadcast_nodes + 1, []
    for forest in forests:
        nodes = forest.small(broadcast_nodes)
        if nodes is None:
            alone = score_forest(features, forest, broadcast_nodes)
            parts.append(alone.select(F.lit(forest.combo_id).alias("forest_id"), "bin_id", "score"))
            continue
        if held + len(nodes) > broadcast_nodes:
            passes.append([])
            held = 0
        passes[-1].append((forest, nodes))
        held += len(nodes)
    parts = [_score_pass(features, p) for p in passes] + parts
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _score_pass(features: DataFrame, forests: list[tuple[Forest, pd.DataFrame]]) -> DataFrame:
    used = sorted({n for forest, _ in forests for n in forest.feature_names})
    # All forests read one matrix.
    models = [(f.combo_id, _pack(nodes, used), f.trees * average_path(f.psi)) for f, nodes in forests]
    shared = features.sparkSession.sparkContext.broadcast(models)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[used].to_numpy(dtype=float, na_value=np.nan)
            for forest_id, packed, scale in shared.value:
                if len(pdf):
                    yield pd.DataFrame({"forest_id": forest_id, "bin_id": pdf["bin_id"], "score": 2.0 ** (-_total_path(packed, x) / scale)})

    return _rounded(features, used).mapInPandas(score, "forest_id int, bin_id string, score double")


def forest_shape(nodes: DataFrame) -> DataFrame:
    """What must hold for every tree, one row per (combo_id, tree_id): counts of nodes and leaves, rows in the leaves, deepest level,
    and how many nodes are at fault: an inner node without two children of its size together, a leaf with children, a node without its parent.
    """
    key = ["combo_id", "tree_id"]
    leaf = F.col("feature").isNull()
    parent = F.floor(F.col("node_id") / 2)
    below = nodes.where("node_id > 1").groupBy(*key, parent.alias("node_id")).agg(
        F.count(F.lit(1)).alias("_children"), F.sum("size").alias("_below")
    )
    both = nodes.join(below, [*key, "node_id"], "full")
    sound = F.when(leaf, F.col("_children").isNull() & F.col("size").isNotNull()).otherwise(
        (F.col("_children") == 2) & (F.col("_below") == F.col("size")) & F.col("threshold").isNotNull()
    )
    return both.groupBy(*key).agg(
        F.count("size").alias("nodes"),
        F.count_if(leaf).alias("leaves"),
        F.sum(F.when(leaf, F.col("size"))).alias("rows"),
        F.max(F.length(F.bin("node_id")) - 1).alias("depth"),
        F.count_if(~F.coalesce(sound, F.lit(False))).alias("faults"),
    )


def score_offset(scores: DataFrame, contamination: float, task_rows: int = TASK_ROWS) -> DataFrame:
    """One row: the score above which a share ``contamination`` of the rows lies."""
    rows = scores.select("score", F.lit(1).alias("_all"))
    quantile = exact_quantiles(rows, ["_all"], ["score"], [1 - contamination], task_rows)
    return quantile.select(F.col("score_q")[0].alias("offset"))


def score_by_type(
    features: DataFrame, forest_i: Forest | None, forest_d: Forest | None, broadcast_nodes: int = BROADCAST_NODES
) -> DataFrame:
    """I bins scored by the I model and D bins by the D model; a type without a model is skipped."""
    forests = {kind: forest for kind, forest in (("I", forest_i), ("D", forest_d)) if forest is not None}
    if not forests:
        raise ValueError("no model given")
    tables = {k: f.small(broadcast_nodes) for k, f in forests.items()}
    if all(nodes is not None for nodes in tables.values()):
        kind = F.substring("bin_id", 1, 1)
        return _score_small(features.filter(kind.isin(*forests)), {k: (f, tables[k]) for k, f in forests.items()})
    return merge_scores([score_forest(filter_bin_type(features, k), f, broadcast_nodes) for k, f in forests.items()])


def _range_values(name: str, default) -> Column:
    """Array of values of one searched parameter from its range columns."""
    values, low, high, steps = (F.col(f"{name}_{part}") for part in ("values", "low", "high", "steps"))
    step = F.try_divide(high - low, (steps - 1).cast("double"))
    spread = F.transform(
        F.sequence(F.lit(0), steps - 1),
        lambda i: F.when(i == 0, low).when(i == steps - 1, high).otherwise(low + i * step),
    )
    empty = F.array().cast("array<double>")
    problem = F.raise_error(F.lit(f"range of {name} needs values, or low, high and steps"))
    complete = low.isNotNull() & high.isNotNull() & steps.isNotNull()
    absent = low.isNull() & high.isNull() & steps.isNull()
    numbers = (
        F.when(values.isNotNull(), values)
        .when(complete & (steps <= 0), empty)
        .when(complete, spread)
        .when(~absent, problem.cast("array<double>"))
    )
    return F.coalesce(F.transform(numbers, lambda v: v.cast("string")), F.array(F.lit(str(default))))


# Parameters of a search in order, with their defaults.
GRID_DEFAULTS = {"contamination": 0.1, "max_samples": "auto", "max_features": 1.0}


def param_grid(searches: DataFrame, defaults: dict | None = None) -> DataFrame:
    """All parameter combinations of each search, one row per combination.

    Each search row carries ``<name>_values`` or ``<name>_low/_high/_steps`` for
    contamination, max_samples and max_features; a parameter without either takes
    its default. Values are text, as max_samples may be ``auto``.
    """
    defaults = {**GRID_DEFAULTS, **(defaults or {})}
    out = searches
    for name, default in defaults.items():
        out = out.withColumn(name, F.explode(_range_values(name, default)))
    folder = F.concat_ws("_", *[F.concat(F.lit(f"{name}_"), F.col(name)) for name in defaults])
    kept = [c for c in searches.columns if not c.startswith(tuple(f"{n}_" for n in defaults))]
    return out.select(*kept, *defaults, folder.alias("subdir"))


def search_row(spark: SparkSession, ranges: dict[str, ValueRange], search_id: int = 0) -> DataFrame:
    """One search as a row for :func:`param_grid`."""
    parts, cells = ["search_id int"], [search_id]
    for name in GRID_DEFAULTS:
        given = ranges.get(name, ValueRange())
        parts.append(f"{name}_values array<double>, {name}_low double, {name}_high double, {name}_steps int")
        listed = [float(v) for v in given.values] if given.values is not None else None
        cells += [listed, *[None if v is None else float(v) for v in (given.low, given.high)], given.steps]
    return spark.createDataFrame([tuple(cells)], ", ".join(parts))


def _as_params(contamination: str, max_samples: str, max_features: str, trees: int, seed: int) -> ForestParams:
    share = float(contamination)
    if not 0 < share <= 0.5:
        raise ValueError(f"contamination {contamination} is outside (0, 0.5]")
    drawn = "auto" if max_samples == "auto" else float(max_samples)
    if drawn != "auto":
        if drawn <= 0:
            raise ValueError(f"max_samples {max_samples} is not positive")
        drawn = int(drawn) if drawn > 1 else drawn
    columns = float(max_features)
    if columns <= 0:
        raise ValueError(f"max_features {max_features} is not positive")
    return ForestParams(share, drawn, int(columns) if columns > 1 else columns, trees, seed)


def grid_search(
    features: DataFrame, grid: DataFrame, trees: int = 100, seed: int = 0, task_rows: int = TASK_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Train every combination; returns (status per combination, nodes of all forests).

    All trees of all combinations grow in one job, grouped by (combination, tree).
    Combinations that differ only in contamination share their trees. A
    combination with impossible parameters is recorded as failed; the others go on.
    The grid itself is a parameter list, so it is read by the driver.
    """
    spark = features.sparkSession
    names = sorted(c for c in features.columns if c != "bin_id")
    features = materialize(features)
    rows = features.count()
    status, specs, shared = [], [], {}
    for combo, row in enumerate(grid.select(*GRID_DEFAULTS, "subdir").collect()):
        try:
            params = _as_params(row.contamination, row.max_samples, row.max_features, trees, seed)
            drawn = (params.sample_size(rows), params.feature_count(len(names)))
            if drawn not in shared:
                shared[drawn] = combo
                specs.append(_Spec(combo, *drawn, trees, seed))
            status.append((combo, row.subdir, params.contamination, shared[drawn], drawn[0], True, None))
        except ValueError as problem:
            status.append((combo, row.subdir, None, None, None, False, str(problem)))
    table = spark.createDataFrame(
        status, "combo_id int, subdir string, contamination double, forest_id int, psi bigint, ok boolean, error string"
    )
    if not specs:
        return table.withColumn("offset", F.lit(None).cast("double")), spark.createDataFrame([], NODE_SCHEMA)
    nodes = materialize(_grow(features, names, specs, rows, task_rows))
    forests = [Forest(nodes.filter(F.col("combo_id") == s.combo_id), tuple(names), s.psi, trees, s.combo_id) for s in specs]
    scored = score_forests(features, forests).select("forest_id", "score")
    shares = sorted({s[2] for s in status if s[5]})
    quantiles = exact_quantiles(materialize(scored), ["forest_id"], ["score"], [1 - share for share in shares], task_rows)
    pairs = F.arrays_zip(F.array(*[F.lit(share) for share in shares]).alias("share"), F.col("score_q").alias("offset"))
    offsets = quantiles.select("forest_id", F.inline(pairs))
    matched = (table.forest_id == offsets.forest_id) & (table.contamination == offsets.share)
    return table.join(offsets, matched, "left").select(table["*"], "offset"), nodes

