"""Isolation forests: training, scoring, search, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from binflow.bindings import load
from binflow.operators import forest as ops
from binflow.operators.features import flow_features, named_features
from binflow.params import ForestParams
from binflow.plans import evaluation
from binflow.plans.flow import FlowRun
from binflow.plans.training import train_run
from binflow.registry import query
from binflow.registry.features import features_sql
from binflow.registry.rounding import rounded
from binflow.registry.scores import _STATS_SQL, DENSITY_SQL, PAIRED_SQL
from binflow.session import materialize, scratch_path

# Two small forests with known nodes: (tree, node, feature, threshold, size).
FIXED_I = [
    (0, 1, "mean_x", 0.49, 16), (0, 2, "std_y", 0.288, 9), (0, 3, None, None, 7), (0, 4, None, None, 4), (0, 5, None, None, 5),
    (1, 1, "core_fraction", 0.25, 16), (1, 2, None, None, 3), (1, 3, "median_y", 0.51, 13), (1, 6, None, None, 12), (1, 7, None, None, 1),
    (2, 1, "skew_x", 0.1, 16), (2, 2, None, None, 2), (2, 3, "t_y_var", 0.008, 14), (2, 6, "mean_y", 0.5, 6), (2, 7, None, None, 8),
    (2, 12, None, None, 1), (2, 13, None, None, 5),
]
FIXED_D = [
    (0, 1, "mean_y", 0.51, 16), (0, 2, None, None, 10), (0, 3, "std_x", 0.29, 6), (0, 6, None, None, 2), (0, 7, None, None, 4),
    (1, 1, "kurt_y", -1.2, 16), (1, 2, "mean_x", 0.5, 8), (1, 3, None, None, 8), (1, 4, None, None, 1), (1, 5, None, None, 7),
]
PSI = 16


def _names(nodes):
    return tuple(sorted({n[2] for n in nodes if n[2]}))


def _fixed(spark, nodes):
    rows = [(0, t, n, f, th, 2 * n if f else None, 2 * n + 1 if f else None, size) for t, n, f, th, size in nodes]
    return ops.Forest(spark.createDataFrame(rows, ops.NODE_SCHEMA), _names(nodes), PSI, len({n[0] for n in nodes}))


def score_sql(nodes) -> str:
    """Score expression of a fixed forest as nested CASE."""
    table = {(t, n): (f, th, size) for t, n, f, th, size in nodes}

    def path(tree: int, node: int) -> str:
        feature, threshold, size = table[tree, node]
        if feature is None:
            return repr(node.bit_length() - 1 + ops.average_path(size)) + "::double"
        return f"case when round({feature}, 9) >= {threshold}::double then {path(tree, 2 * node + 1)} else {path(tree, 2 * node)} end"

    trees = sorted({n[0] for n in nodes})
    total = " + ".join(f"({path(t, 1)})" for t in trees)
    return f"pow(2e0, -({total}) / {len(trees) * ops.average_path(PSI)!r}::double)"


_USED = tuple(sorted(set(_names(FIXED_I)) | set(_names(FIXED_D))))
_FEATURES = features_sql(_USED, 9).removeprefix("with ")
_HEAD, _TAIL = _FEATURES.rsplit("\nselect ", 1)
_SCORED = f"""{_HEAD}, feats as (select {_TAIL}),
    scored as (select bin_id, case when bin_id like 'I%' then {score_sql(FIXED_I)} else {score_sql(FIXED_D)} end as score from feats)"""


@query("score_forest", f"with {_SCORED} select bin_id, round({score_sql(FIXED_I)}, 6) as score from feats")
def score_forest(spark, sf):
    features = named_features(load(spark, sf, "points"), list(_names(FIXED_I)))
    return rounded(ops.score_forest(features, _fixed(spark, FIXED_I)))


@query("score_by_type", f"with {_SCORED} select bin_id, round(score, 6) as score from scored")
def score_by_type(spark, sf):
    features = named_features(load(spark, sf, "points"), list(_USED))
    return rounded(ops.score_by_type(features, _fixed(spark, FIXED_I), _fixed(spark, FIXED_D)))


_SETS = f"""{_SCORED}, sets as (select case when substr(bin_id, 2)::int % 7 = 0 then 'bad' else 'normal' end as label, bin_id, score from scored)"""
_EVALUATED = f"{_SETS}, {PAIRED_SQL.replace('{sets}', 'sets')}"


def _sides(spark, sf):
    """Bins whose number is a multiple of 7 stand for the known-bad folders."""
    points = load(spark, sf, "points")
    bad = F.substring("bin_id", 2, 6).cast("int") % 7 == 0
    return points.filter(bad), points.filter(~bad)


@query("full_evaluation", f"with {_EVALUATED} select scope, label, {_STATS_SQL} from paired group by scope, label")
def full_evaluation(spark, sf):
    return rounded(evaluation.full_evaluation(*_sides(spark, sf), _fixed(spark, FIXED_I), _fixed(spark, FIXED_D)))


@query("full_evaluation_density", f"with {_EVALUATED}, {DENSITY_SQL} select * from density")
def full_evaluation_density(spark, sf):
    return rounded(evaluation.full_evaluation_density(*_sides(spark, sf), _fixed(spark, FIXED_I), _fixed(spark, FIXED_D)))


@query("train_forest")
def train_forest(spark, sf):
    """Trains on all bins, keeps and reloads the model, scores and flags the bins."""
    features = materialize(flow_features(load(spark, sf, "points")))
    model = ops.train_forest(features, ForestParams(trees=50, max_samples=64, seed=7))
    path = scratch_path(spark, "forest")
    model.save(path)
    scores = ops.score_forest(features, ops.Forest.load(spark, path))
    limit = ops.score_offset(scores, 0.1).scalar()
    return rounded(scores.withColumn("is_anomaly", F.col("score") > limit))


@query(
    "forest_shape",
    """select 0 as combo_id, t::int as tree_id, least(64, n)::bigint as rows, true as nodes_fit_leaves, true as depth_fits, 0::bigint as faults
       from range(0, 50) r(t), (select count(distinct l_suppkey) as n from {lineitem})""",
)
def forest_shape(spark, sf):
    """Every tree of a trained forest: psi rows in its leaves, a binary tree, at most log2(psi) levels, each node the sum of its children."""
    features = materialize(flow_features(load(spark, sf, "points")))
    shape = ops.forest_shape(ops.train_forest(features, ForestParams(trees=50, max_samples=64, seed=7)).nodes)
    return shape.select(
        "combo_id", "tree_id", "rows", (F.col("nodes") == 2 * F.col("leaves") - 1).alias("nodes_fit_leaves"), (F.col("depth") <= 6).alias("depth_fits"), "faults"
    )


@query(
    "training_run",
    """with b as (select bin_type, count(distinct l_suppkey) as n from {bins} join {lineitem} on substr(bin_id, 2)::int = l_suppkey group by bin_type)
       select bin_type, t::int as tree_id, least(16, n)::bigint as rows, 0::bigint as faults from b, range(0, 10) r(t)""",
)
def training_run(spark, sf):
    """One model for each bin type through the training plan: its trees hold rows of that type only."""
    root = scratch_path(spark, "training")
    out = None
    for kind in ("I", "D"):
        flow = FlowRun(spark, f"train-{kind}", f"{root}/prov")
        model = train_run(flow, f"{root}/{kind}", load(spark, sf, "bins"), load(spark, sf, "points"), kind, params=ForestParams(trees=10, max_samples=16, seed=1))
        shape = ops.forest_shape(model.nodes).select(F.lit(kind).alias("bin_type"), "tree_id", "rows", "faults")
        out = shape if out is None else out.unionByName(shape)
    return out


_GRID = {"contamination": (0.05, 0.1, 0.9), "max_samples": (32, 64)}


@query(
    "grid_shape",
    """with n as (select count(distinct l_suppkey) as bins from {lineitem}),
            c as (select row_number() over (order by i, j) - 1 as combo, share, drawn
                  from (values (0, 0.05), (1, 0.1), (2, 0.9)) a(i, share), (values (0, 32), (1, 64)) b(j, drawn))
       select combo::int as combo_id, share <= 0.5 as ok, case when share > 0.5 then concat('contamination ', share::double, ' is outside (0, 0.5]') else 'none' end as error,
              case when share > 0.5 then -1 when least(drawn, bins) = least(32, bins) then 0 else 1 end::int as forest_id,
              true as share_sound,
              case when share <= 0.5 then 20 else 0 end::bigint as trees, case when share <= 0.5 then 20 * least(drawn, bins) else 0 end::bigint as rows, 0::bigint as faults
       from c, n""",
)
def grid_shape(spark, sf):
    """Every combination of a search: its status, and of its forest the trees, the rows in them and what is at fault; the share
    of bins above its offset is the contamination."""
    features = materialize(flow_features(load(spark, sf, "points")))
    ranges = {k: ops.ValueRange(values=v) for k, v in _GRID.items()}
    status, nodes = ops.grid_search(features, ops.param_grid(ops.search_row(spark, ranges)), trees=20, seed=3)
    status = materialize(status)
    shape = ops.forest_shape(nodes).groupBy(F.col("combo_id").alias("forest_id")).agg(
        F.count(F.lit(1)).alias("trees"), F.sum("rows").alias("rows"), F.sum("faults").alias("faults")
    )
    ids = [r.forest_id for r in status.where("ok").select("forest_id", "psi").distinct().collect()]
    psi = {r.forest_id: r.psi for r in status.where("ok").collect()}
    names = tuple(sorted(c for c in features.columns if c != "bin_id"))
    forests = [ops.Forest(nodes.filter(F.col("combo_id") == i), names, psi[i], 20, i) for i in ids]
    scores = ops.score_forests(features, forests)
    above = (
        status.where("ok")
        .join(scores, "forest_id")
        .groupBy("combo_id", "contamination")
        .agg(F.count_if(F.col("score") > F.col("offset")).alias("_above"), F.count(F.lit(1)).alias("_bins"))
        .select("combo_id", (F.col("_above") <= F.ceil(F.col("_bins") * F.col("contamination"))).alias("share_sound"))
    )
    both = status.join(above, "combo_id", "left").join(shape, "forest_id", "left")
    return both.select(
        "combo_id", "ok", F.coalesce("error", F.lit("none")).alias("error"), F.coalesce("forest_id", F.lit(-1)).alias("forest_id"),
        F.coalesce("share_sound", F.lit(True)).alias("share_sound"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("trees", "rows", "faults")],
    )


def _searches(spark, sf):
    """One search per supplier: listed or default contamination, spaced sample counts."""
    key = F.col("s_suppkey")
    listed = F.when(key % 2 == 0, F.array(F.lit(0.05), F.lit(0.1)))
    return load(spark, sf, "supplier").select(
        key.alias("search_id"),
        listed.alias("contamination_values"),
        *[F.lit(None).cast("double").alias(f"contamination_{p}") for p in ("low", "high")],
        F.lit(None).cast("int").alias("contamination_steps"),
        F.lit(None).cast("array<double>").alias("max_samples_values"),
        (64 + key % 8).cast("double").alias("max_samples_low"),
        F.lit(256.0).alias("max_samples_high"),
        (1 + key % 4).cast("int").alias("max_samples_steps"),
        F.lit(None).cast("array<double>").alias("max_features_values"),
        *[F.lit(None).cast("double").alias(f"max_features_{p}") for p in ("low", "high")],
        F.lit(None).cast("int").alias("max_features_steps"),
    )


@query(
    "param_grid",
    """with g as (select s_suppkey as search_id, unnest(case when s_suppkey % 2 = 0 then ['0.05', '0.1'] else ['0.1'] end) as contamination,
                  64 + s_suppkey % 8 as low, s_suppkey % 4 as top from {supplier}),
            s as (select search_id, contamination, low, top, unnest(range(0, top + 1)) as i from g),
            v as (select search_id, contamination,
                  cast(case when i = 0 then low::double when i = top then 256e0 else low + i * ((256e0 - low) / top) end as varchar) as max_samples from s)
       select search_id, contamination, max_samples, '1.0' as max_features,
              concat('contamination_', contamination, '_max_samples_', max_samples, '_max_features_1.0') as subdir from v""",
)
def param_grid(spark, sf):
    return ops.param_grid(_searches(spark, sf))


@query("grid_search")
def grid_search(spark, sf):
    """Search grid of one listed and one spaced range over the features of all bins."""
    features = flow_features(load(spark, sf, "points"))
    ranges = {
        "contamination": ops.ValueRange(values=(0.05, 0.1, 0.9)),
        "max_samples": ops.ValueRange(low=32, high=64, steps=2),
    }
    grid = ops.param_grid(ops.search_row(spark, ranges))
    status, _ = ops.grid_search(features, grid, trees=20, seed=3)
    return rounded(status.fillna("none", ["error"]))
