"""Runs of several tasks that note each finished task as provenance."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime
from typing import TypeVar

from pyspark.sql import SparkSession

from binflow.operators.provenance import append_provenance

Result = TypeVar("Result")
RUN_SCHEMA = "flow_run_id string, task_key string, name string, started timestamp"


class FlowRun:
    """One run of a flow. A task that raises is not noted, and the run ends there; without a ``root`` nothing is noted."""

    def __init__(self, spark: SparkSession, flow_run_id: str, root: str | None = None):
        self.spark, self.flow_run_id, self.root = spark, flow_run_id, root
        self.counts: dict[str, int] = {}

    def task(self, name: str, work: Callable[[], Result]) -> Result:
        """Do the work, which writes its outputs, then note it under its name and a number within the run."""
        started = datetime.now(UTC)
        result = work()
        number = self.counts.get(name, 0)
        self.counts[name] = number + 1
        if self.root is not None:
            row = (self.flow_run_id, f"{name}-{number}", name, started)
            append_provenance(self.spark.createDataFrame([row], RUN_SCHEMA), self.root)
        return result
