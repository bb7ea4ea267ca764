"""The paths for groups too large for one task give the same results as the plain ones."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from binflow.bindings import load
from binflow.functions import scale
from binflow.functions.scale import exact_quantiles, hot_keys, number_rows
from binflow.operators import features
from binflow.registry.rounding import rounded


def _skewed(spark, n=3000):
    """A third of the rows share one key; values repeat and span magnitudes."""
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40))
    value = F.when(F.col("id") % 5 == 0, F.lit(7.0)).otherwise(F.pow(F.lit(10.0), (F.xxhash64("id") % 9).cast("double")))
    return spark.range(n).select(key.alias("k"), value.alias("v"), (F.col("id") % 11).cast("double").alias("w"))


def test_hot_keys_names_only_large_groups(spark):
    assert [r.k for r in hot_keys(_skewed(spark), ["k"], 500).collect()] == ["hot"]
    assert hot_keys(_skewed(spark), ["k"], 100_000) is None


@pytest.mark.parametrize("limit", [1, 60, 500])
def test_spread_quantiles_match_percentile(spark, limit):
    df = _skewed(spark)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {r.k: (r.v_q, r.w_q) for r in exact_quantiles(df, ["k"], ["v", "w"], probs, limit).collect()}
    wanted = F.array(*[F.lit(p) for p in probs])
    want = df.groupBy("k").agg(F.percentile("v", wanted).alias("v"), F.percentile("w", wanted).alias("w")).collect()
    assert len(got) == len(want)
    for r in want:
        np.testing.assert_allclose(got[r.k][0], r.v, rtol=1e-9)
        np.testing.assert_allclose(got[r.k][1], r.w, rtol=1e-9)


def _adversarial(spark, kind, n=4000):
    """Values that a sketch or a histogram over equal cells splits badly."""
    i = F.col("id")
    value = {
        "one value": F.lit(-0.0),
        "two values": F.when(i % 2 == 0, -0.0).otherwise(0.0),
        "ties and magnitudes": F.when(i % 3 == 0, 5.0).otherwise(F.pow(F.lit(10.0), (i % 600 - 300).cast("double")) * F.when(i % 2 == 0, 1).otherwise(-1)),
        "neighbours": F.lit(1.0) + (i % 7).cast("double") * F.lit(2.220446049250313e-16),
        "infinite": F.when(i % 5 == 0, float("inf")).when(i % 5 == 1, float("-inf")).otherwise(i.cast("double")),
    }[kind]
    return spark.range(n).select(F.lit("a").alias("k"), value.alias("v"))


@pytest.mark.parametrize("kind", ["one value", "two values", "ties and magnitudes", "neighbours", "infinite"])
def test_missed_brackets_are_narrowed_exactly(spark, monkeypatch, kind):
    """With a sketch of accuracy 2 brackets miss, or hold nearly everything."""
    monkeypatch.setattr(scale, "SKETCH", 2)
    df = _adversarial(spark, kind)
    probs = [0.0, 0.2, 0.37, 0.5, 0.9, 1.0] if kind != "infinite" else [0.1, 0.5, 0.95]
    want = df.agg(F.percentile("v", F.array(*[F.lit(p) for p in probs])).alias("v")).first().v
    got = scale.spread_quantiles(df, ["k"], ["v"], probs, 10).first().v_q
    assert got == pytest.approx(want, rel=1e-12)


def test_no_task_sorts_a_wide_bracket(spark, monkeypatch):
    """What the last windows sort: at most task_rows distinct values of a rank."""
    seen = []
    plain = scale._pick

    def watched(inside, group, ranks):
        sizes = inside.groupBy(*group, "_i", "_rank").agg(F.count_distinct("_v").alias("n")).agg(F.max("n")).first()[0]
        seen.append(sizes or 0)
        return plain(inside, group, ranks)

    monkeypatch.setattr(scale, "SKETCH", 2)
    monkeypatch.setattr(scale, "_pick", watched)
    df = spark.range(20_000).select(F.lit("a").alias("k"), F.sqrt(F.col("id").cast("double")).alias("v"))
    got = scale.spread_quantiles(df, ["k"], ["v"], [0.25, 0.5], 50).first().v_q
    want = df.agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5))).alias("v")).first().v
    assert got == pytest.approx(want, rel=1e-12) and 0 < max(seen) <= 50


def test_two_ranks_in_one_cell_are_counted_apart(spark, monkeypatch):
    """A target between two values of one cell of the histogram, whose bracket misses its rank."""
    monkeypatch.setattr(scale, "SKETCH", 2)
    df = spark.range(402).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("v"))
    assert scale.spread_quantiles(df, ["k"], ["v"], [0.25, 0.75], 390).first().v_q == [100.25, 300.75]


def test_spread_quantiles_ignore_nulls(spark):
    df = spark.range(100).select(F.lit("a").alias("k"), F.when(F.col("id") % 2 == 0, F.col("id").cast("double")).alias("v"))
    assert exact_quantiles(df, ["k"], ["v"], [0.5], 10).first().v_q == [49.0]


def test_number_rows(spark, small):
    rows = load(spark, small, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber")
    order = ["l_shipdate", "l_orderkey", "l_linenumber"]
    want = rows.withColumn("rn", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*order)).cast("bigint"))
    assert number_rows(rows, order, ["l_suppkey"]).exceptAll(want).isEmpty()
    whole = number_rows(rows, [F.desc("l_suppkey"), *order])
    want = rows.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("l_suppkey"), *order)).cast("bigint"))
    assert whole.exceptAll(want).isEmpty() and whole.count() == rows.count()


@pytest.mark.parametrize("limit", [7, 100, 450])
def test_hot_bins_have_the_same_features(spark, small, limit):
    points = load(spark, small, "points")
    want = {r.bin_id: r for r in features.flow_features(points).collect()}
    got = {r.bin_id: r for r in features.flow_features(points, task_rows=limit).collect()}
    assert set(got) == set(want)
    for bin_id, row in want.items():
        np.testing.assert_allclose(np.array(got[bin_id][1:], float), np.array(row[1:], float), rtol=1e-7, atol=1e-12)


@pytest.mark.parametrize("limit", [3, 40])
def test_rolling_mean_of_hot_bins(spark, small, limit):
    points = load(spark, small, "points").select("bin_id", "seq", "x", "y")
    want = rounded(features.rolling_mean_y(points), 9)
    got = rounded(features.rolling_mean_y(points, task_rows=limit), 9)
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()


def test_hot_bins_of_null_values_and_null_names_stay(spark, small):
    points = load(spark, small, "points")
    names = F.when(F.col("bin_id") == points.agg(F.min("bin_id")).scalar(), None).otherwise(F.col("bin_id"))
    blank = points.limit(300).withColumns({"bin_id": F.lit("I1"), "x": F.lit(None).cast("double"), "y": F.lit(None).cast("double")})
    rows = points.withColumn("bin_id", names).unionByName(blank)
    want = {r.bin_id: r for r in features.flow_features(rows).collect()}
    got = {r.bin_id: r for r in features.flow_features(rows, task_rows=20).collect()}
    assert None in want and "I1" in want and set(got) == set(want)
    for bin_id, row in want.items():
        np.testing.assert_allclose(np.array(got[bin_id][1:], float), np.array(row[1:], float), rtol=1e-7, atol=1e-12)


def test_many_hot_keys_are_a_table(spark, monkeypatch):
    df = _skewed(spark)
    want = exact_quantiles(df, ["k"], ["v"], [0.5]).collect()
    monkeypatch.setattr("binflow.functions.scale.BROADCAST_KEYS", 3)
    assert sorted(exact_quantiles(df, ["k"], ["v"], [0.5], 10).collect()) == sorted(want)
