"""Helpers that keep very large groups spread over many tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from binflow.session import materialize

#: A group of at most this many rows may be sorted or buffered by one task.
TASK_ROWS = 1_000_000
#: Most group keys that are broadcast; more are a written table, and Spark chooses the join.
BROADCAST_KEYS = 200_000
#: Sketch accuracy: the bracket around a wanted rank holds about 8/SKETCH of a group.
SKETCH = 20_000


def hot_keys(df: DataFrame, keys: list[str], task_rows: int = TASK_ROWS) -> DataFrame | None:
    """Keys of the groups above ``task_rows`` rows, or None when there are none.

    Runs one partial aggregation over the key columns. Up to BROADCAST_KEYS keys
    are broadcast. A NULL key is a key; :func:`join_on` meets it.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > task_rows).select(*keys)
    found = sizes.limit(BROADCAST_KEYS + 1).collect()
    if not found:
        return None
    if len(found) > BROADCAST_KEYS:
        return materialize(sizes)
    return F.broadcast(df.sparkSession.createDataFrame(found, sizes.schema))


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join by equal keys, where NULL equals NULL; the keys come from the left side."""
    named = right.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return left.join(named, same, how).drop(*[f"_key_{k}" for k in keys])


def split_hot(df: DataFrame, keys: list[str], task_rows: int = TASK_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary groups, and rows of hot groups if there are any."""
    hot = hot_keys(df, keys, task_rows)
    if hot is None:
        return df, None
    return join_on(df, hot, keys, "left_anti"), join_on(df, hot, keys, "left_semi")


def lay_out(df: DataFrame, keys: list[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """Rows placed for a write partitioned by ``keys``: an ordinary group in one
    task, so in one file; a hot group over all tasks."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordinary, hot = split_hot(df, keys, task_rows)
    laid = ordinary.repartition(parts, *keys)
    return laid if hot is None else laid.unionByName(hot.repartition(parts).select(*df.columns))


def exact_quantiles(
    df: DataFrame, keys: list[str], values: list[str], probs: list[float], task_rows: int = TASK_ROWS
) -> DataFrame:
    """Linear-interpolated quantiles per group: one ``<value>_q`` array per value column.

    Ordinary groups use the built-in ``percentile``. Hot groups are never
    buffered: see :func:`spread_quantiles`.
    """
    rows = df.select(*keys, *values)
    ordinary, hot = split_hot(rows, keys, task_rows)
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    buffered = ordinary.groupBy(*keys).agg(*[F.percentile(v, wanted).alias(f"{v}_q") for v in values])
    if hot is None:
        return buffered
    return buffered.unionByName(spread_quantiles(hot, keys, values, probs, task_rows))


def spread_quantiles(
    df: DataFrame, keys: list[str], values: list[str], probs: list[float], task_rows: int = TASK_ROWS
) -> DataFrame:
    """Exact quantiles of few, very large groups without gathering any of them.

    A mergeable sketch brackets each wanted rank, one partial aggregation counts
    the rows below and inside each bracket, and only the distinct values inside
    the brackets are sorted. A bracket that misses its rank, or holds more than ``task_rows`` rows, is
    not sorted: :func:`_select_wide` narrows it down by counting. So the result does not depend on the sketch, and no
    task sorts more than ``task_rows`` values. As with ``percentile``, a group without values has NULL instead of an array.
    """
    long = df.select(
        *keys, F.explode(F.array(*[F.struct(F.lit(v).alias("_name"), F.col(v).cast("double").alias("_v")) for v in values])).alias("_s")
    ).select(*keys, "_s._name", "_s._v").filter(F.col("_v").isNotNull())
    group = [*keys, "_name"]
    reach = 4.0 / SKETCH
    low = F.array(*[F.lit(max(0.0, p - reach)) for p in probs])
    high = F.array(*[F.lit(min(1.0, p + reach)) for p in probs])
    sketch = long.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"),
        F.approx_percentile("_v", low, SKETCH).alias("_lo"),
        F.approx_percentile("_v", high, SKETCH).alias("_hi"),
    )
    brackets = F.array(
        *[
            F.struct(
                F.lit(i).alias("_i"),
                F.lit(float(p)).alias("_p"),
                F.any_value(F.col("_lo")[i]).alias("_lo"),
                F.any_value(F.col("_hi")[i]).alias("_hi"),
                F.count_if(F.col("_v") < F.col("_lo")[i]).alias("_below"),
                F.count_if(F.col("_v") <= F.col("_hi")[i]).alias("_upto"),
            )
            for i, p in enumerate(probs)
        ]
    )
    counted = (
        join_on(long, sketch, group)
        .groupBy(*group)
        .agg(F.any_value("_n").alias("_n"), brackets.alias("_b"))
        .select(*group, "_n", F.explode("_b").alias("_b"))
        .select(*group, "_n", "_b.*")
    )
    rank = F.col("_p") * (F.col("_n") - 1)
    sound = (F.col("_below") <= F.floor(rank)) & (F.ceil(rank) < F.col("_upto"))
    held = F.col("_upto") - F.col("_below")
    targets = materialize(counted.select(*group, "_i", rank.alias("_rank"), "_lo", "_hi", "_below", (~sound | (held > task_rows)).alias("_wide")))
    narrow = targets.where(~F.col("_wide")).drop("_wide")
    inside = join_on(long, narrow, group).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    picked = _pick(inside, group, [F.floor("_rank"), F.ceil("_rank")])
    wide = targets.where("_wide").select(*group, "_i", "_rank")
    if not wide.isEmpty():
        picked = picked.unionByName(_select_wide(long, wide, group, task_rows))
    frac = F.col("_rank") - F.floor("_rank")
    between = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * frac
    filled = picked.withColumn("_q", F.when(F.col("_v0") == F.col("_v1"), F.col("_v0")).otherwise(between))  # infinities, too
    quantiles = filled.groupBy(*keys).agg(
        *[
            F.when(
                F.count_if(F.col("_name") == v) > 0,
                F.array(*[F.max(F.when((F.col("_name") == v) & (F.col("_i") == i), F.col("_q"))) for i in range(len(probs))]),
            ).alias(f"{v}_q")
            for v in values
        ]
    )
    return join_on(df.select(*keys).distinct(), quantiles, keys, "left")


def _pick(inside: DataFrame, group: list[str], ranks: list[Column]) -> DataFrame:
    """The values ``_v0`` and ``_v1`` at two ranks (from 0, in the group) of each target (``_i``, ``_rank``), among the rows
    of which ``_below`` come before."""
    counts = inside.groupBy(*group, "_i", "_rank", "_below", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.col("_below") + F.sum("_c").over(
        Window.partitionBy(*group, "_i", "_rank", "_below").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    )
    ranked = counts.withColumn("_cum", upto)
    at = [F.min(F.when(F.col("_cum") > r, F.col("_v"))).alias(f"_v{i}") for i, r in enumerate(ranks)]
    return ranked.groupBy(*group, "_i", "_rank").agg(*at)


@F.pandas_udf(LongType())
def _ordered_bits(values: pd.Series) -> pd.Series:
    """The bits of doubles, changed so that as unsigned numbers they have the order of the values."""
    bits = (values.to_numpy(dtype=float) + 0.0).view(np.int64)  # -0.0 is 0.0
    return pd.Series(np.where(bits < 0, ~bits, bits ^ np.int64(-(1 << 63))))


def _select_wide(long: DataFrame, targets: DataFrame, group: list[str], task_rows: int) -> DataFrame:
    """Values at the ranks of ``targets`` by refining a histogram over the bits of the values.

    Each round counts the values that share the bits found so far by their next 16, with partial aggregation: at most
    65,536 counts per rank meet in a task. The cell of the rank gives the next bits. After four rounds, or once a cell holds
    at most ``task_rows`` rows, one value or so few are left; ties of any number are one value.
    """
    keyed = materialize(join_on(long, targets.select(*group).distinct(), group).withColumn("_key", _ordered_bits("_v")))
    ranks = F.explode(F.array_distinct(F.array(F.floor("_rank"), F.ceil("_rank"))))
    state = targets.select(*group, "_i", "_rank", ranks.alias("_k"), F.lit(0).cast("bigint").alias("_prefix"), F.lit(0).cast("bigint").alias("_below"))
    found = None
    for shift in (48, 32, 16, 0):
        rows = join_on(keyed, state, group)
        if shift < 48:
            rows = rows.where(F.shiftrightunsigned("_key", shift + 16) == F.col("_prefix"))
        digit = F.shiftrightunsigned("_key", shift).bitwiseAND(65535)
        cells = rows.groupBy(*group, "_i", "_rank", "_k", "_prefix", "_below", digit.alias("_digit")).agg(F.count(F.lit(1)).alias("_c"))
        upto = F.col("_below") + F.sum("_c").over(
            Window.partitionBy(*group, "_i", "_k").orderBy("_digit").rowsBetween(Window.unboundedPreceding, 0)
        )
        reached = cells.withColumn("_cum", upto).where((F.col("_cum") > F.col("_k")) & (F.col("_cum") - F.col("_c") <= F.col("_k")))
        state = materialize(
            reached.select(
                *group, "_i", "_rank", "_k", F.shiftleft("_prefix", 16).bitwiseOR(F.col("_digit")).alias("_prefix"),
                (F.col("_cum") - F.col("_c")).alias("_below"), "_c",
            )
        )
        settled = F.lit(True) if shift == 0 else F.col("_c") <= task_rows
        few = state.where(settled).drop("_c")
        inside = join_on(keyed, few, group).where(F.shiftrightunsigned("_key", shift) == F.col("_prefix"))
        # One rank at a time: the rank stands in the place of a target's number.
        one = inside.withColumn("_rank", F.struct("_rank", "_k"))
        picked = _pick(one, group, [F.col("_rank._k")]).select(*group, "_i", "_rank._rank", "_v0")
        found = picked if found is None else found.unionByName(picked)
        state = state.where(~settled).drop("_c")
        if shift and state.isEmpty():
            break
    # The two ranks of a target, the lower one first.
    return found.groupBy(*group, "_i", "_rank").agg(F.min("_v0").alias("_v0"), F.max("_v0").alias("_v1"))


def number_rows(
    df: DataFrame, order_by: list[Column | str], within: list[str] | None = None, name: str = "rn"
) -> DataFrame:
    """Row number from 1 in a total order, overall or per ``within`` group.

    Rows are range-partitioned by (group, order), so neither the whole table nor
    a huge group is sorted by one task. Numbers follow from the position inside
    a partition plus the rows of the group in earlier partitions. The sorted
    rows are written first: the offsets and the rows must come from the
    same partitioning even when tasks are retried.
    """
    within = within or []
    keys = [F.col(k) for k in within]
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    laid = materialize(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_pos", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_pos", 33))
    pieces = laid.groupBy("_part", *within).agg(F.count(F.lit(1)).alias("_c"), F.min("_pos").alias("_first"))
    # One row per partition and group; a group spans few partitions.
    earlier = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        "_part", *within, "_first", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before")
    )
    if not within:
        offsets = F.broadcast(offsets)  # one row per partition
    same = F.col("r._part") == F.col("o._part")
    for k in within:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}"))
    number = (F.col("_before") + F.col("_pos") - F.col("_first") + 1).alias(name)
    return laid.alias("r").join(offsets.alias("o"), same).select(*[F.col(f"r.{c}") for c in df.columns], number)
