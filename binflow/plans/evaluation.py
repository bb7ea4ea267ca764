"""Known-bad against normal bins, from point clouds to score distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binflow.functions.scale import TASK_ROWS
from binflow.operators.features import named_features
from binflow.operators.forest import Forest, score_by_type
from binflow.operators.scores import bad_vs_normal, score_density, score_distribution
from binflow.params import FlowParams
from binflow.session import materialize


def score_points(
    points: DataFrame, forest_i: Forest | None, forest_d: Forest | None, params: FlowParams = FlowParams(), task_rows: int = TASK_ROWS
) -> DataFrame:
    """Scores of bins given as points. Only the features the models use are computed."""
    names = sorted({n for f in (forest_i, forest_d) if f is not None for n in f.feature_names})
    return score_by_type(named_features(points, names, params, task_rows), forest_i, forest_d)


def labelled_scores(
    bad: DataFrame, normal: DataFrame, forest_i: Forest | None, forest_d: Forest | None, params: FlowParams = FlowParams()
) -> DataFrame:
    """Scores of both sides, labelled "bad" and "normal".

    Both sides go through one pass: the label travels behind the identifier,
    which is a file name and so holds no slash. The comparison reads the scores
    several times, so they are written once: one row per bin.
    """
    sides = [p.withColumn("bin_id", F.concat("bin_id", F.lit(f"/{label}"))) for p, label in ((bad, "bad"), (normal, "normal"))]
    scores = score_points(sides[0].unionByName(sides[1]), forest_i, forest_d, params)
    return materialize(
        scores.select(
            F.substring_index("bin_id", "/", 1).alias("bin_id"), "score", F.substring_index("bin_id", "/", -1).alias("label")
        )
    )


def full_evaluation(
    bad: DataFrame, normal: DataFrame, forest_i: Forest | None, forest_d: Forest | None, params: FlowParams = FlowParams()
) -> DataFrame:
    """Distribution of bad and normal scores for I bins, D bins and both together."""
    paired = bad_vs_normal(labelled_scores(bad, normal, forest_i, forest_d, params))
    return score_distribution(paired, ["scope", "label"])


def full_evaluation_density(
    bad: DataFrame, normal: DataFrame, forest_i: Forest | None, forest_d: Forest | None, params: FlowParams = FlowParams(), width: float = 0.05
) -> DataFrame:
    """Density of the same sets per score cell."""
    paired = bad_vs_normal(labelled_scores(bad, normal, forest_i, forest_d, params))
    return score_density(paired, ["scope", "label"], width)
