"""Per-bin features of the particle point cloud.

Input columns: bin_id, seq, trigger_id, x, y, has_roi. The definitions are this
package's own; only the feature names and their one-line meanings are given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binflow.functions.scale import TASK_ROWS, join_on, split_hot, spread_quantiles
from binflow.params import FEATURE_GROUPS, FEATURE_NAMES, FlowParams, enabled_features

QUARTILES = [0.25, 0.5, 0.75]
_NEED_QUARTILES = {"median_x", "median_y", "iqr_x", "iqr_y", "ratio_spread", "core_fraction"}
_NEED_RANGE = {"cv_x", "cv_y"}
_NEED_ROLLING = {"t_y_var"}
_PER_VALUE = set(FEATURE_GROUPS["clipping_detection"])
_PER_TRIGGER = set(FEATURE_GROUPS["trigger_stats"])


def rolling_mean_y(points: DataFrame, size: int = 10, task_rows: int = TASK_ROWS) -> DataFrame:
    """Adds ``roll``: mean of y over the last ``size`` rows of a bin, NULL before a full window.

    A bin above ``task_rows`` rows is cut along seq into blocks of about that
    size; each block gets the last ``size - 1`` rows before it, so every window
    is whole and no task sorts the entire bin.
    """
    ordinary, hot = split_hot(points, ["bin_id"], task_rows)
    rolled = _rolling_by(ordinary, ["bin_id"], size)
    return rolled if hot is None else rolled.unionByName(_rolling_by_block(hot, size, task_rows))


def _rolling_by(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    frame = Window.partitionBy(*keys).orderBy("seq", "x", "y").rowsBetween(-(size - 1), 0)
    full = F.count(F.lit(1)).over(frame) == size
    return rows.withColumn("roll", F.when(full, F.avg("y").over(frame)))


def _rolling_by_block(points: DataFrame, size: int, task_rows: int) -> DataFrame:
    span = points.groupBy("bin_id").agg(
        F.min("seq").alias("_first"),
        (F.max("seq") - F.min("seq") + 1).alias("_span"),
        F.ceil(F.count(F.lit(1)) / task_rows).alias("_blocks"),
    )
    block = F.expr("(seq - _first) div greatest(1, _span div _blocks)")
    cut = join_on(points, span, ["bin_id"]).select(*points.columns, block.alias("_block"))
    key = ["bin_id", "_block"]
    latest = Window.partitionBy(*key).orderBy(F.desc("seq"), F.desc("x"), F.desc("y"))
    tails = (
        cut.withColumn("_r", F.row_number().over(latest))
        .filter(F.col("_r") < size)
        .groupBy(*key)
        .agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y")), asc=False).alias("_tail"))
    )
    # Blocks without rows do not appear, so the size - 1 blocks before always suffice.
    before = Window.partitionBy("bin_id").orderBy(F.desc("_block")).rowsBetween(1, size - 1)
    halo = tails.select(*key, F.slice(F.flatten(F.collect_list("_tail").over(before)), 1, size - 1).alias("_h")).select(
        *key, F.inline("_h")
    )
    both = cut.withColumn("_own", F.lit(True)).unionByName(halo.withColumn("_own", F.lit(False)), True)
    return _rolling_by(both, key, size).filter("_own").drop("_block", "_own")


def _with_context(rows: DataFrame, wanted: set[str], params: FlowParams) -> DataFrame:
    """Quartiles, range and rolling mean beside each row: one shuffle on bin_id."""
    if wanted & _NEED_ROLLING:
        rows = _rolling_by(rows, ["bin_id"], params.window)
    whole = Window.partitionBy("bin_id")
    probs = F.array(*[F.lit(p) for p in QUARTILES])
    if wanted & _NEED_QUARTILES:
        rows = rows.withColumns({f"{v}_q": F.percentile(v, probs).over(whole) for v in "xy"})
    if wanted & _NEED_RANGE:
        rows = rows.withColumns({f"{v}_{f.__name__}": f(v).over(whole) for v in "xy" for f in (F.min, F.max)})
    return rows


def _with_spread_context(rows: DataFrame, wanted: set[str], params: FlowParams, task_rows: int) -> DataFrame:
    """The same columns for hot bins: per-bin values, one row per hot bin, come from partial
    aggregates and are joined back."""
    if wanted & _NEED_ROLLING:
        rows = _rolling_by_block(rows, params.window, task_rows)
    if wanted & _NEED_QUARTILES:
        rows = join_on(rows, spread_quantiles(rows, ["bin_id"], ["x", "y"], QUARTILES), ["bin_id"])
    if wanted & _NEED_RANGE:
        span = rows.groupBy("bin_id").agg(*[f(v).alias(f"{v}_{f.__name__}") for v in "xy" for f in (F.min, F.max)])
        rows = join_on(rows, span, ["bin_id"])
    return rows


def _with_cells(rows: DataFrame, cells: int) -> DataFrame:
    """Equal-width cell of x and of y in the bin's range; NULL when there is no range."""

    def cell(v: str) -> Column:
        low, high = F.col(f"{v}_min"), F.col(f"{v}_max")
        return F.when(high > low, F.least(F.floor((F.col(v) - low) / (high - low) * cells), F.lit(cells - 1)).cast("int"))

    return rows.withColumns({f"{v}_cell": cell(v) for v in "xy"})


def _cell_variation(cell: str, cells: int) -> Column:
    """Standard deviation over mean of the counts per cell, empty ones included."""
    counts = [F.count_if(F.col(cell) == i) for i in range(cells)]
    total = sum(counts[1:], counts[0])
    squares = sum((c * c for c in counts[1:]), counts[0] * counts[0])
    mean = total / cells
    return F.try_divide(F.sqrt(F.greatest(squares / cells - mean * mean, F.lit(0.0))), F.nullif(mean, F.lit(0.0)))


def _row_features(wanted: set[str], params: FlowParams) -> dict[str, Column]:
    """Aggregate expressions over the rows of a bin."""
    x, y = F.col("x"), F.col("y")
    xq, yq = F.col("x_q"), F.col("y_q")
    iqr = {v: F.any_value(F.col(f"{v}_q")[2] - F.col(f"{v}_q")[0]) for v in "xy"}
    inside = x.between(xq[0], xq[2]) & y.between(yq[0], yq[2])
    mixed = F.covar_pop(x, y)
    vx, vy = F.var_pop(x), F.var_pop(y)
    half_gap = F.sqrt(((vx - vy) / 2) * ((vx - vy) / 2) + mixed * mixed)
    middle = (vx + vy) / 2
    left, right = x <= params.edge_margin * params.aspect_ratio, x >= (1 - params.edge_margin) * params.aspect_ratio
    top, bottom = y <= params.edge_margin, y >= 1 - params.edge_margin

    def share(condition: Column) -> Column:
        return F.avg(condition.cast("double"))

    table = {
        "mean_x": lambda: F.avg(x),
        "mean_y": lambda: F.avg(y),
        "std_x": lambda: F.stddev_pop(x),
        "std_y": lambda: F.stddev_pop(y),
        "median_x": lambda: F.any_value(xq[1]),
        "median_y": lambda: F.any_value(yq[1]),
        "iqr_x": lambda: iqr["x"],
        "iqr_y": lambda: iqr["y"],
        "ratio_spread": lambda: F.try_divide(iqr["y"], iqr["x"]),
        "core_fraction": lambda: share(inside),
        "cv_x": lambda: _cell_variation("x_cell", params.cells),
        "cv_y": lambda: _cell_variation("y_cell", params.cells),
        "skew_x": lambda: F.skewness(x),
        "skew_y": lambda: F.skewness(y),
        "kurt_x": lambda: F.kurtosis(x),
        "kurt_y": lambda: F.kurtosis(y),
        "angle": lambda: F.when((vx > 0) | (vy > 0), F.atan2(2 * mixed, vx - vy) / 2),
        "eigen_ratio": lambda: F.try_divide(middle + half_gap, middle - half_gap),
        "left_edge_fraction": lambda: share(left),
        "right_edge_fraction": lambda: share(right),
        "top_edge_fraction": lambda: share(top),
        "bottom_edge_fraction": lambda: share(bottom),
        "total_edge_fraction": lambda: share(left | right | top | bottom),
        "t_y_var": lambda: F.var_pop("roll"),
    }
    return {name: make() for name, make in table.items() if name in wanted}


def duplicate_features(points: DataFrame) -> DataFrame:
    """Share of points whose y occurs more than once, and the largest share of one y."""
    per_value = points.groupBy("bin_id", (F.col("y") + F.lit(0.0)).alias("y")).agg(F.count("y").alias("_c"))
    total = F.sum("_c")
    return per_value.groupBy("bin_id").agg(
        F.try_divide(F.sum(F.when(F.col("_c") > 1, F.col("_c")).otherwise(0)), total).alias("duplicate_fraction"),
        F.try_divide(F.max("_c"), total).alias("max_duplicate_fraction"),
    )


def trigger_features(points: DataFrame) -> DataFrame:
    """Share of a bin's triggers with at least one particle image."""
    per_trigger = points.groupBy("bin_id", "trigger_id").agg(F.max(F.col("has_roi").cast("double")).alias("_hit"))
    return per_trigger.groupBy("bin_id").agg(F.avg("_hit").alias("roi_trigger_fraction"))


def flow_features(
    points: DataFrame,
    switches: dict[str, dict[str, bool]] | None = None,
    params: FlowParams = FlowParams(),
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """One row per bin with the enabled features, in their fixed order.

    Features that need a bin's rows beside its quartiles, range or order share
    one shuffle on bin_id. Plain aggregates combine map-side instead. Groups
    that are switched off are not computed at all.
    """
    return named_features(points, enabled_features(switches), params, task_rows)


def named_features(
    points: DataFrame, names: list[str], params: FlowParams = FlowParams(), task_rows: int = TASK_ROWS
) -> DataFrame:
    """As :func:`flow_features` for an explicit list of feature names."""
    wanted = set(names)
    roi = points.filter("has_roi").select("bin_id", "seq", "x", "y")
    parts = []
    if wanted & _PER_TRIGGER:
        parts.append(trigger_features(points))
    plain = _row_features(wanted, params)
    if plain:
        rows = roi
        if wanted & (_NEED_QUARTILES | _NEED_RANGE | _NEED_ROLLING):
            ordinary, hot = split_hot(roi, ["bin_id"], task_rows)
            rows = _with_context(ordinary, wanted, params)
            if hot is not None:
                rows = rows.unionByName(_with_spread_context(hot, wanted, params, task_rows))
            if wanted & _NEED_RANGE:
                rows = _with_cells(rows, params.cells)
        parts.append(rows.groupBy("bin_id").agg(*[c.alias(name) for name, c in plain.items()]))
    if wanted & _PER_VALUE:
        parts.append(duplicate_features(roi))
    # The first table has every bin of the others: all points come before those with an image.
    out = parts[0]
    for part in parts[1:]:
        out = join_on(out, part, ["bin_id"], "left")
    return out.select("bin_id", *[name for name in FEATURE_NAMES if name in wanted])


def select_features(features: DataFrame, switches: dict[str, dict[str, bool]] | None = None) -> DataFrame:
    """Keep the enabled features that the table has; unknown names are ignored."""
    kept = [name for name in enabled_features(switches) if name in features.columns]
    return features.select("bin_id", *kept)
