"""Column expressions on numbers, score vectors and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(scores: Column) -> Column:
    """Scores that sum to 1. Rows already non-negative with sum 1 +- 1e-3 are kept."""
    zero = F.lit(0.0)
    total = F.aggregate(scores, zero, lambda acc, v: acc + v)
    ready = F.forall(scores, lambda v: v >= 0) & (F.abs(total - 1.0) <= 1e-3)
    # A one-element array binds a value, so that it is computed once and not for each element.
    bound = lambda value, use: F.get(F.transform(F.array(value), use), 0)
    powers = bound(F.array_max(scores), lambda top: F.transform(scores, lambda v: F.exp(v - top)))

    def scaled(p: Column) -> Column:
        return bound(F.aggregate(p, zero, lambda acc, w: acc + w), lambda whole: F.transform(p, lambda v: v / whole))

    return F.when(ready, scores).otherwise(bound(powers, scaled))


def top_class(scores: Column) -> Column:
    """Position of the highest score from 0; the lowest position wins ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def box_iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two boxes given as x1, y1, x2, y2 columns."""

    def area(box: dict[str, Column]) -> Column:
        return (box["x2"] - box["x1"]) * (box["y2"] - box["y1"])

    wide = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    tall = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    shared = wide * tall
    return F.try_divide(shared, area(a) + area(b) - shared)


def pearson(x: Column, y: Column) -> Column:
    """Pearson correlation, NULL when either side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
