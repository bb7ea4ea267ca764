"""Embedding vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_embeddings(df: DataFrame, path: str, column: str = "embedding") -> None:
    """Vectors as float arrays beside their other columns."""
    df.withColumn(column, F.col(column).cast("array<float>")).write.mode("overwrite").parquet(path)
