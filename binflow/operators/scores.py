"""Anomaly scores: comparison sets, distributions and flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binflow.functions.scale import TASK_ROWS, exact_quantiles
from binflow.sources.scores import merge_scores

# The scopes of the comparison.
MERGED = "merged"


def merge_i_and_d(i_scores: DataFrame | None, d_scores: DataFrame | None) -> DataFrame | None:
    """Union of whichever of the two sets is given."""
    given = [s for s in (i_scores, d_scores) if s is not None]
    return merge_scores(given) if given else None


def bad_vs_normal(scores: DataFrame) -> DataFrame:
    """Scores paired per scope: bins of type I, bins of type D, and both merged.

    ``scores`` has label ("bad" or "normal"), bin_id and score. A scope without
    bins on one side is left out.
    """
    kind = F.substring("bin_id", 1, 1)
    scoped = scores.filter(kind.isin("I", "D")).select(
        F.explode(F.array(kind, F.lit(MERGED))).alias("scope"), "label", "bin_id", "score"
    )
    two_sided = (
        scoped.groupBy("scope")
        .agg((F.bool_or(F.col("label") == "bad") & F.bool_or(F.col("label") == "normal")).alias("_both"))
        .filter("_both")
        .select("scope")
    )
    # At most three scopes.
    return scoped.join(F.broadcast(two_sided), "scope", "left_semi")


def score_distribution(scores: DataFrame, by: list[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """n, min, quartiles, max and mean of each set."""
    base = scores.groupBy(*by).agg(
        F.count("score").alias("n"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
        F.avg("score").alias("mean_score"),
    )
    quartiles = exact_quantiles(scores, by, ["score"], [0.25, 0.5, 0.75], task_rows)
    return base.join(quartiles, by).select(
        *by,
        "n",
        "min_score",
        *[F.col("score_q")[i].alias(name) for i, name in enumerate(("q1", "median", "q3"))],
        "max_score",
        "mean_score",
    )


def score_density(scores: DataFrame, by: list[str], width: float = 0.05) -> DataFrame:
    """Bins and density of each set per score cell, as far as cells hold bins."""
    cells = scores.filter(F.col("score").isNotNull()).groupBy(*by, F.floor(F.col("score") / width).alias("cell"))
    counts = cells.agg(F.count(F.lit(1)).alias("bins"))
    totals = counts.groupBy(*by).agg(F.sum("bins").alias("_n"))
    return counts.join(totals, by).select(
        *by, "cell", (F.col("cell") * width).alias("from_score"), "bins", (F.col("bins") / (F.col("_n") * width)).alias("density")
    )


def anomaly_rank(scores: DataFrame, contamination: float = 0.1, task_rows: int = TASK_ROWS) -> DataFrame:
    """Flags the share ``contamination`` of bins with the highest scores.

    All scores form one group, so the threshold comes from the spread quantiles.
    """
    rows = scores.select("score", F.lit(1).alias("_all"))
    threshold = exact_quantiles(rows, ["_all"], ["score"], [1 - contamination], task_rows)
    limit = threshold.select(F.col("score_q")[0]).scalar()
    return scores.withColumn("is_anomaly", F.col("score") > limit)
