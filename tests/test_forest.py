import numpy as np
import pytest
from pyspark.sql import functions as F

from binflow.operators import forest as ops
from binflow.params import ForestParams, ValueRange


@pytest.fixture(scope="module")
def features(spark):
    """Two hundred ordinary bins and one far outlier; one feature has gaps."""
    a = (F.xxhash64("id", F.lit(1)) % 1000) / 1000.0
    b = (F.xxhash64("id", F.lit(2)) % 1000) / 1000.0
    bins = spark.range(200).select(
        F.concat(F.when(F.col("id") % 2 == 0, "D").otherwise("I"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("bin_id"),
        a.alias("a"),
        b.alias("b"),
        F.when(F.col("id") % 4 != 0, a * b).alias("c"),
    )
    outlier = spark.createDataFrame([("D999999", 9.0, -9.0, 9.0)], bins.schema)
    return bins.unionByName(outlier)


PARAMS = ForestParams(trees=25, max_samples=64, seed=5)


def _nodes(model):
    return sorted((r.tree_id, r.node_id, r.feature, r.threshold, r.size) for r in model.nodes.collect())


def test_partitioning_does_not_change_the_forest(features):
    assert _nodes(ops.train_forest(features, PARAMS)) == _nodes(ops.train_forest(features.repartition(13), PARAMS))


def test_outlier_scores_highest(features):
    scores = ops.score_forest(features, ops.train_forest(features, PARAMS)).orderBy(F.desc("score")).collect()
    assert scores[0].bin_id == "D999999" and scores[0].score > scores[1].score + 0.05
    assert all(0 < r.score < 1 for r in scores)


def test_every_tree_holds_psi_rows(features):
    model = ops.train_forest(features, PARAMS)
    roots = model.nodes.filter("node_id = 1").collect()
    assert len(roots) == 25 and {r.size for r in roots} == {64}
    leaves = model.nodes.filter("feature is null").groupBy("tree_id").agg(F.sum("size").alias("n")).collect()
    assert {r.n for r in leaves} == {64}


@pytest.mark.parametrize("max_samples, task_rows", [(1.0, 20), (100, 30)])
def test_large_nodes_are_split_across_tasks(features, max_samples, task_rows):
    params = ForestParams(trees=6, max_samples=max_samples, seed=2, max_features=2)
    model = ops.train_forest(features, params, task_rows=task_rows)
    nodes = {(r.tree_id, r.node_id): r for r in model.nodes.collect()}
    assert {nodes[t, 1].size for t in range(6)} == {params.sample_size(201)}
    for (tree, node), r in nodes.items():
        if r.feature is not None:
            assert nodes[tree, 2 * node].size + nodes[tree, 2 * node + 1].size == r.size
    best = ops.score_forest(features, model).orderBy(F.desc("score")).first()
    assert best.bin_id == "D999999"


def test_slices_of_trees_give_the_same_scores(features):
    model = ops.train_forest(features, PARAMS)
    whole = {r.bin_id: r.score for r in ops.score_forest(features, model).collect()}
    again = ops.Forest(model.nodes, model.feature_names, model.psi, model.trees)
    parts = {r.bin_id: r.score for r in ops.score_forest(features, again, broadcast_nodes=300).collect()}
    assert len(again.slices(300)[0]) > 1 and not again.slices(300)[1]
    for bin_id, score in whole.items():
        assert parts[bin_id] == pytest.approx(score, rel=1e-9)


def test_repeated_identifiers_have_a_score_each_in_slices(features):
    twice = features.unionByName(features.filter("bin_id = 'D999999'"))
    model = ops.train_forest(features, PARAMS)
    whole = sorted(r.score for r in ops.score_forest(twice, model).filter("bin_id = 'D999999'").collect())
    again = ops.Forest(model.nodes, model.feature_names, model.psi, model.trees)
    parts = sorted(r.score for r in ops.score_forest(twice, again, broadcast_nodes=300).filter("bin_id = 'D999999'").collect())
    assert len(parts) == 2 and parts == pytest.approx(whole, rel=1e-9)


@pytest.mark.parametrize("task_rows", [1, 7, 30])
def test_task_size_does_not_change_the_forest(features, task_rows):
    gaps = features.withColumn("b", F.when(F.col("b") > 0.5, F.lit(float("nan"))).otherwise(F.col("b")))
    params = ForestParams(trees=4, max_samples=100, seed=2, max_features=2)
    want = _nodes(ops.train_forest(gaps, params))
    assert not any(r[3] is not None and np.isnan(r[3]) for r in want)
    assert sorted(map(str, _nodes(ops.train_forest(gaps, params, task_rows=task_rows)))) == sorted(map(str, want))


def test_missing_feature_is_an_error(features):
    model = ops.train_forest(features, PARAMS)
    with pytest.raises(ValueError, match="missing"):
        ops.score_forest(features.drop("b"), model)


def test_model_round_trip(spark, features, tmp_path):
    model = ops.train_forest(features, PARAMS)
    model.save(str(tmp_path))
    back = ops.Forest.load(spark, str(tmp_path))
    assert _nodes(back) == _nodes(model)
    assert (back.feature_names, back.psi, back.trees) == (model.feature_names, 64, 25)


def test_offset_flags_the_share(features):
    scores = ops.score_forest(features, ops.train_forest(features, PARAMS))
    limit = ops.score_offset(scores, 0.1).first().offset
    assert scores.filter(F.col("score") > limit).count() == pytest.approx(20, abs=1)


def test_sample_sizes():
    assert ForestParams().sample_size(1000) == 256 and ForestParams().sample_size(10) == 10
    assert ForestParams(max_samples=0.5).sample_size(1000) == 500
    assert ForestParams(max_samples=5000).sample_size(1000) == 1000
    assert ForestParams(max_features=0.5).feature_count(27) == 13 and ForestParams(max_features=3).feature_count(27) == 3


def test_average_path():
    assert ops.average_path(1) == 0 and ops.average_path(2) == 1
    assert ops.average_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_param_grid_order_and_names(spark):
    ranges = {"contamination": ValueRange(values=(0.05, 0.1)), "max_samples": ValueRange(low=64, high=256, steps=3)}
    rows = ops.param_grid(ops.search_row(spark, ranges)).collect()
    assert [(r.contamination, r.max_samples, r.max_features) for r in rows][:3] == [
        ("0.05", "64.0", "1.0"), ("0.05", "160.0", "1.0"), ("0.05", "256.0", "1.0"),
    ]
    assert len(rows) == 6 and rows[0].subdir == "contamination_0.05_max_samples_64.0_max_features_1.0"


def test_param_grid_defaults_and_faults(spark):
    only = ops.param_grid(ops.search_row(spark, {})).collect()
    assert [(r.contamination, r.max_samples, r.max_features) for r in only] == [("0.1", "auto", "1.0")]
    one = ops.param_grid(ops.search_row(spark, {"max_samples": ValueRange(low=8, high=9, steps=1)})).collect()
    assert [r.max_samples for r in one] == ["8.0"]
    with pytest.raises(Exception, match="needs values"):
        ops.param_grid(ops.search_row(spark, {"max_samples": ValueRange(low=8)})).collect()


def test_grid_search_records_failures(spark, features):
    ranges = {"contamination": ValueRange(values=(0.05, 0.1, 0.9)), "max_samples": ValueRange(values=(32, 64))}
    status, nodes = ops.grid_search(features, ops.param_grid(ops.search_row(spark, ranges)), trees=5)
    rows = {(r.contamination, r.psi): r for r in status.filter("ok").collect()}
    assert len(rows) == 4 and status.filter("not ok").count() == 2
    assert rows[0.05, 32].offset >= rows[0.1, 32].offset
    assert rows[0.05, 32].forest_id == rows[0.1, 32].forest_id != rows[0.05, 64].forest_id
    assert nodes.select("combo_id").distinct().count() == 2


def test_score_by_type_uses_each_model(features):
    i = ops.train_forest(features.filter("bin_id like 'I%'"), PARAMS)
    d = ops.train_forest(features.filter("bin_id like 'D%'"), PARAMS, names=["a", "b"])
    got = {r.bin_id: r.score for r in ops.score_by_type(features, i, d).collect()}
    for kind, model in (("I", i), ("D", d)):
        for r in ops.score_forest(features.filter(F.col("bin_id").startswith(kind)), model).collect():
            assert got[r.bin_id] == pytest.approx(r.score)
    assert ops.score_by_type(features, i, None).filter("bin_id like 'D%'").isEmpty()


def test_threshold_ties_go_right():
    split = ops._split(np.array([[1.0], [2.0], [np.nan]]), np.array([4]), (0, 0, 0, 1))
    assert split[0] == 4 and 1.0 < split[1] <= 2.0
    assert ops._split(np.array([[1.0], [1.0], [np.nan]]), np.array([4]), np.random.default_rng(0)) is None


@pytest.mark.parametrize("most", [1, 40, 90])
def test_trees_above_the_broadcast_are_walked(features, most):
    """Trees of more nodes than may be broadcast, mixed with smaller ones, give the scores of the whole table."""
    model = ops.train_forest(features, ForestParams(trees=6, max_samples=64, seed=5))
    sizes = sorted(r["count"] for r in model.nodes.groupBy("tree_id").count().collect())
    assert sizes[0] > 40
    want = {r.bin_id: r.score for r in ops.score_forest(features, model).collect()}
    again = ops.Forest(model.nodes, model.feature_names, model.psi, model.trees)
    got = ops.score_forest(features, again, broadcast_nodes=most).collect()
    assert len(got) == features.count()
    assert all(r.score == pytest.approx(want[r.bin_id], rel=1e-12) for r in got)


def test_several_forests_in_one_pass(features):
    models = [ops.train_forest(features, ForestParams(trees=4, max_samples=n, seed=n)) for n in (16, 32, 48)]
    for i, m in enumerate(models):
        m.combo_id = i
    want = {(i, r.bin_id): r.score for i, m in enumerate(models) for r in ops.score_forest(features, m).collect()}
    for most in (5_000_000, 200, 100):
        fresh = [ops.Forest(m.nodes, m.feature_names, m.psi, m.trees, m.combo_id) for m in models]
        df = ops.score_forests(features, fresh, most)
        got = {(r.forest_id, r.bin_id): r.score for r in df.collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    plan = ops.score_forests(features, models)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and plan.count("Union") == 1  # the one of the features


def test_forest_shape_finds_faults(spark, features):
    model = ops.train_forest(features, ForestParams(trees=3, max_samples=32, seed=1))
    shape = ops.forest_shape(model.nodes).collect()
    assert [(r.rows, r.faults, r.nodes) for r in shape] == [(32, 0, 2 * r.leaves - 1) for r in shape] and len(shape) == 3
    leaf = model.nodes.where("feature is null and node_id > 1").orderBy("tree_id", "node_id").first()
    broken = model.nodes.where(~((F.col("tree_id") == leaf.tree_id) & (F.col("node_id") == leaf.node_id)))
    assert {r.tree_id: r.faults for r in ops.forest_shape(broken).collect()}[leaf.tree_id] > 0
