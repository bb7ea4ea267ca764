"""Provenance of finished tasks as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binflow.session import path_exists

# Node type, relation and label prefixes.
ACTIVITY = "ACTIVITY"
WAS_GENERATED_BY = "WAS_GENERATED_BY"


def _labels(task_runs: DataFrame) -> DataFrame:
    return task_runs.select(
        "*",
        F.concat(F.lit("task-"), "task_key").alias("task_label"),
        F.concat(F.lit("flow-"), "flow_run_id").alias("flow_label"),
    )


def prov_nodes(task_runs: DataFrame) -> DataFrame:
    """One node per task key and per flow run; a label has one description."""
    named = _labels(task_runs)
    tasks = named.select(F.col("task_label").alias("label"), F.col("name").alias("description"))
    flows = named.select(F.col("flow_label").alias("label"), F.col("flow_run_id").cast("string").alias("description"))
    both = tasks.unionByName(flows)
    return both.groupBy("label").agg(F.min("description").alias("description")).select("label", F.lit(ACTIVITY).alias("type"), "description")


def prov_edges(task_runs: DataFrame) -> DataFrame:
    """One relation from flow to task per finished task."""
    return _labels(task_runs).select(
        F.col("flow_label").alias("subject"),
        F.lit(WAS_GENERATED_BY).alias("verb"),
        F.col("task_label").alias("object"),
        F.concat_ws("_", "flow_run_id", "task_key").alias("run_id"),
        F.col("started").alias("start_time"),
    )


def tasks_of(edges: DataFrame, flows: DataFrame) -> DataFrame:
    """(flow, task) of the wanted flows, given as a column ``flow``."""
    pairs = edges.select(F.col("subject").alias("flow"), F.col("object").alias("task"))
    return pairs.join(flows.select("flow"), "flow", "left_semi")


def flows_of(edges: DataFrame, tasks: DataFrame) -> DataFrame:
    """(flow, task) of the wanted tasks, given as a column ``task``."""
    pairs = edges.select(F.col("subject").alias("flow"), F.col("object").alias("task"))
    return pairs.join(tasks.select("task"), "task", "left_semi").select("flow", "task")


def append_provenance(task_runs: DataFrame, root: str) -> None:
    """Append nodes not stored yet and all edges below ``root``."""
    spark = task_runs.sparkSession
    nodes = prov_nodes(task_runs)
    if path_exists(spark, f"{root}/prov_node"):
        nodes = nodes.join(spark.read.parquet(f"{root}/prov_node").select("label"), "label", "left_anti")
    nodes.write.mode("append").parquet(f"{root}/prov_node")
    prov_edges(task_runs).write.mode("append").parquet(f"{root}/prov_edge")
