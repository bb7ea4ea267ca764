"""Training of the model of one bin type, from point rows to a stored forest."""

from __future__ import annotations

from pyspark.sql import DataFrame

from binflow.operators.features import flow_features
from binflow.operators.forest import Forest, train_forest
from binflow.operators.select import select_units, training_ids
from binflow.params import FlowParams, ForestParams
from binflow.plans.flow import FlowRun
from binflow.session import materialize
from binflow.sources.bins import write_id_list


def train_run(
    flow: FlowRun,
    out: str,
    bins: DataFrame,
    points: DataFrame,
    bin_type: str,
    ids: DataFrame | None = None,
    params: ForestParams = ForestParams(),
    switches: dict[str, dict[str, bool]] | None = None,
    flow_params: FlowParams = FlowParams(),
) -> Forest:
    """Train on the bins of a type, or on the listed ones whatever their type; returns the stored model.

    Writes ``model`` and, when the type chose the bins, ``ids`` below ``out``. ValueError where no bin is found, before any
    point is read. Only points of chosen bins become features, and features that are switched off are not computed.
    """

    def choose() -> DataFrame:
        chosen = materialize(training_ids(bins, ids, bin_type).distinct())
        if chosen.isEmpty():
            raise ValueError("the list of bins to train on is empty")
        if ids is None:
            write_id_list(chosen, bin_type, f"{out}/ids")
        return chosen

    def train(chosen: DataFrame) -> Forest:
        features = materialize(flow_features(select_units(points, chosen), switches, flow_params))
        train_forest(features, params).save(f"{out}/model")
        return Forest.load(flow.spark, f"{out}/model")

    chosen = flow.task("training_ids", choose)
    return flow.task("train", lambda: train(chosen))
