"""Contents of a detection data set by split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binflow.functions import text
from binflow.sources.store import list_files


def dataset_catalog(images: DataFrame, labels: DataFrame, names: DataFrame) -> DataFrame:
    """(split, figure, name, n): images, unmatched images and labels, objects per class.

    ``images`` has split and stem, ``labels`` one row per labelled object with
    split, stem and class_id, ``names`` class_id and name. A split may be absent.
    """
    labelled = labels.select("split", "stem").distinct()

    def counted(df: DataFrame, figure: str) -> DataFrame:
        return df.groupBy("split").agg(F.count(F.lit(1)).alias("n")).select("split", F.lit(figure).alias("figure"), F.lit("all").alias("name"), "n")

    per_class = labels.groupBy("split", "class_id").agg(F.count(F.lit(1)).alias("n"))
    objects = per_class.join(names.select("class_id", "name"), "class_id", "left").select(
        "split", F.lit("objects").alias("figure"), F.coalesce("name", F.col("class_id").cast("string")).alias("name"), "n"
    )
    key = ["split", "stem"]
    return (
        counted(images, "images")
        .unionByName(counted(images.join(labelled, key, "left_anti"), "images without label"))
        .unionByName(counted(labelled.join(images, key, "left_anti"), "labels without image"))
        .unionByName(objects)
    )


def scan_images(spark: SparkSession, root: str) -> DataFrame:
    """(split, stem) of the files below ``<root>/images/<split>``."""
    path = F.col("path")
    split = F.regexp_extract(path, r"/images/([^/]+)/", 1)
    return list_files(spark, f"{root}/images").select(split.alias("split"), text.base_name(path).alias("stem"))


def scan_labels(spark: SparkSession, root: str) -> DataFrame:
    """(split, stem, class_id), one row per line of the files below ``<root>/labels/<split>``."""
    lines = spark.read.option("recursiveFileLookup", "true").text(f"{root}/labels")
    path = F.col("_metadata.file_path")
    return lines.filter(F.trim("value") != "").select(
        F.regexp_extract(path, r"/labels/([^/]+)/", 1).alias("split"),
        text.base_name(path).alias("stem"),
        F.split_part(F.trim("value"), F.lit(" "), F.lit(1)).cast("int").alias("class_id"),
    )


def read_class_names(spark: SparkSession, path: str) -> DataFrame:
    """(class_id, name) from the ``names`` lines of a data set description."""
    pattern = r"^\s+([0-9]+)\s*:\s*(.*?)\s*$"
    lines = spark.read.text(path).filter(F.col("value").rlike(pattern))
    return lines.select(
        F.regexp_extract("value", pattern, 1).cast("int").alias("class_id"), F.regexp_extract("value", pattern, 2).alias("name")
    )
