"""Score sets: union, comparison, distributions, flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from binflow.bindings import load
from binflow.operators import scores as ops
from binflow.operators.select import filter_bin_type, missing_inputs
from binflow.registry import query
from binflow.registry.rounding import rounded
from binflow.session import scratch_path
from binflow.sources import scores as io

_STATS_SQL = """count(score) as n, round(min(score), 6) as min_score, round(quantile_cont(score, 0.25), 6) as q1,
    round(quantile_cont(score, 0.5), 6) as median, round(quantile_cont(score, 0.75), 6) as q3,
    round(max(score), 6) as max_score, round(avg(score), 9) as mean_score"""
PAIRED_SQL = """scoped as (select unnest([substr(bin_id, 1, 1), 'merged']) as scope, label, bin_id, score
              from {sets} where substr(bin_id, 1, 1) in ('I', 'D')),
    paired as (select * from scoped where scope in (select scope from scoped group by scope
              having bool_or(label = 'bad') and bool_or(label = 'normal')))"""
_PAIRED_SQL = PAIRED_SQL.replace("{sets}", "{score_sets}")


def _written(spark, sf):
    """Two score CSV folders with different columns, as two runs leave them."""
    folder = scratch_path(spark, "scores")
    sets = load(spark, sf, "score_sets")
    io.write_scores(sets.filter("label = 'bad'").select("bin_id", "score"), f"{folder}/bad_scores.csv")
    normal = sets.filter("label = 'normal'").select("bin_id", "score", F.floor("score").alias("cell"))
    io.write_scores(normal, f"{folder}/normal_scores.csv")
    return [f"{folder}/{name}.csv" for name in ("bad_scores", "absent", "normal_scores")]


@query(
    "read_score_csvs",
    """select bin_id, round(score, 6) as score, concat(label, '_scores') as source_file,
              coalesce(case when label = 'normal' then floor(score)::int::varchar end, 'none') as cell from {score_sets}""",
)
def read_score_csvs(spark, sf):
    merged = io.read_score_csvs(spark, _written(spark, sf), add_source=True)
    return rounded(merged.withColumn("cell", F.coalesce(F.col("cell").cast("string"), F.lit("none"))))


@query("write_scores", "select bin_id, round(score, 6) as score from {score_sets} where label = 'bad'")
def write_scores(spark, sf):
    path = _written(spark, sf)[0]
    return rounded(spark.read.option("header", True).schema("bin_id string, score double").csv(path))


@query(
    "merge_scores",
    """select bin_id, round(score, 6) as score, coalesce(source_file, 'none') as source_file, coalesce(balance, 'none') as balance from (
         select bin_id, score, 'bad_scores' as source_file, null as balance from {score_sets} where label = 'bad'
         union all
         select bin_id, 1e0, null, 'low' from {score_sets} where label = 'normal' and score < 0.5)""",
)
def merge_scores(spark, sf):
    sets = load(spark, sf, "score_sets")
    bad = sets.filter("label = 'bad'").select("bin_id", "score", F.lit("bad_scores").alias("source_file"))
    low = sets.filter("label = 'normal' and score < 0.5").select("bin_id", F.lit(1).alias("score"), F.lit("low").alias("balance"))
    merged = io.merge_scores([bad, low])
    return rounded(merged.fillna("none", ["source_file", "balance"]))


@query(
    "missing_inputs",
    "select path from {files} where path not in (select path from {manifest})",
)
def missing(spark, sf):
    files = load(spark, sf, "files")
    return missing_inputs(files.unionByName(files), load(spark, sf, "manifest"))


@query("merge_I_and_D", "select label, bin_id, round(score, 6) as score from {score_sets} where substr(bin_id, 1, 1) in ('I', 'D')")
def merge_i_and_d(spark, sf):
    sets = load(spark, sf, "score_sets")
    return rounded(ops.merge_i_and_d(filter_bin_type(sets, "I"), filter_bin_type(sets, "D")))


@query("bad_vs_normal", f"with {_PAIRED_SQL} select scope, label, bin_id, round(score, 6) as score from paired")
def bad_vs_normal(spark, sf):
    return rounded(ops.bad_vs_normal(load(spark, sf, "score_sets")))


@query("score_distribution", f"with {_PAIRED_SQL} select scope, label, {_STATS_SQL} from paired group by scope, label")
def score_distribution(spark, sf):
    return rounded(ops.score_distribution(ops.bad_vs_normal(load(spark, sf, "score_sets")), ["scope", "label"]))


DENSITY_SQL = """score_cells as (select scope, label, floor(score / 0.05e0)::bigint as cell, count(*) as bins from paired group by all),
    density as (select scope, label, cell, round(cell * 0.05e0, 6) as from_score, bins,
               round(bins / (sum(bins) over (partition by scope, label) * 0.05e0), 6) as density from score_cells)"""


@query("score_density", f"with {_PAIRED_SQL}, {DENSITY_SQL} select * from density")
def score_density(spark, sf):
    return rounded(ops.score_density(ops.bad_vs_normal(load(spark, sf, "score_sets")), ["scope", "label"]))


@query(
    "anomaly_rank",
    """select label, bin_id, round(score, 6) as score,
              score > (select quantile_cont(score, 0.9) from {score_sets}) as is_anomaly from {score_sets}""",
)
def anomaly_rank(spark, sf):
    return rounded(ops.anomaly_rank(load(spark, sf, "score_sets"), 0.1))
