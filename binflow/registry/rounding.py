"""Rounding of floating columns, so that two engines can be compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


FINE = ("mean_x", "mean_y", "mean_score")


def places_of(name: str, places: int) -> int:
    """Means and shares fall on short decimals; more places keep them off rounding ties."""
    return max(places, 9) if name in FINE or name.endswith("_fraction") else places


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(
        *[F.round(c, places_of(c, places)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    )
