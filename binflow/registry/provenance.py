"""Provenance, and the incremental run."""

from __future__ import annotations

from pyspark.sql import functions as F

from binflow.bindings import load
from binflow.operators import provenance as ops
from binflow.registry import query
from binflow.session import scratch_path
from binflow.sources.manifest import Ledger
from binflow.streaming.incremental import run_incremental


@query(
    "provenance",
    """select concat('flow-', flow_run_id) as subject, 'WAS_GENERATED_BY' as verb, concat('task-', task_key) as object,
              concat(flow_run_id, '_', task_key) as run_id, strftime(started, '%Y-%m-%d %H:%M:%S') as start_time from {task_runs}""",
)
def provenance(spark, sf):
    edges = ops.prov_edges(load(spark, sf, "task_runs"))
    return edges.withColumn("start_time", F.date_format("start_time", "yyyy-MM-dd HH:mm:ss"))


@query(
    "provenance_nodes",
    """select concat('task-', task_key) as label, 'ACTIVITY' as type, min(name) as description from {task_runs} group by task_key
       union all select distinct concat('flow-', flow_run_id), 'ACTIVITY', flow_run_id::varchar from {task_runs}""",
)
def provenance_nodes(spark, sf):
    return ops.prov_nodes(load(spark, sf, "task_runs"))


@query(
    "lineage",
    """select 'tasks of flow' as direction, concat('flow-', flow_run_id) as flow, concat('task-', task_key) as task from {task_runs} where flow_run_id % 5 = 0
       union all select 'flows of task', concat('flow-', flow_run_id), concat('task-', task_key) from {task_runs} where task_key like 'click-%'""",
)
def lineage(spark, sf):
    runs = load(spark, sf, "task_runs")
    edges = ops.prov_edges(runs)
    flows = runs.filter("flow_run_id % 5 = 0").select(F.concat(F.lit("flow-"), "flow_run_id").alias("flow"))
    tasks = runs.filter("name = 'click'").select(F.concat(F.lit("task-"), "task_key").alias("task"))
    down = ops.tasks_of(edges, flows).select(F.lit("tasks of flow").alias("direction"), "flow", "task")
    return down.unionByName(ops.flows_of(edges, tasks).select(F.lit("flows of task").alias("direction"), "flow", "task"))


def _process(paths: list[str]) -> None:
    for path in paths:
        if path.endswith("3.tif"):
            raise ValueError("cannot process")


@query(
    "incremental_bins",
    """select path, path not like '%3.tif' as ok, count(*) as attempts from {files},
              (select unnest([1, 2]) as run) where run = 1 or path like '%3.tif' group by all""",
)
def incremental_bins(spark, sf):
    """Streams the file list, then runs again without a new file: the failed files are tried a second time."""
    root = scratch_path(spark, "stream")
    load(spark, sf, "files").select("path", "size").write.parquet(f"{root}/in")
    for _ in range(2):
        stream = spark.readStream.schema("path string, size bigint").parquet(f"{root}/in")
        run_incremental(stream, _process, f"{root}/status", f"{root}/checkpoint", buckets=8)
    return Ledger(spark, f"{root}/status").table().groupBy("path", "ok").agg(F.count(F.lit(1)).alias("attempts"))
