"""Bins, their point rows and identifier lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binflow.functions import text
from binflow.functions.scale import lay_out
from binflow.operators.select import filter_bin_type, select_units
from binflow.sources.named import write_named, write_zips
from binflow.sources.store import Files, list_files

#: Bytes of a point file that one task reads at a time; longer files are shared out.
SPLIT_BYTES = 64 << 20
BLOCK_BYTES = 1 << 20


def bins_from_paths(paths: DataFrame) -> DataFrame:
    """One row per ``.adc`` path: bin_id, bin_type, path. Repeated identifiers stay."""
    bin_id = F.regexp_extract("path", r"([^/]+)[.]adc$", 1)
    return paths.filter(F.col("path").endswith(".adc")).select(
        bin_id.alias("bin_id"), F.substring(bin_id, 1, 1).alias("bin_type"), "path"
    )


def scan_bins(spark: SparkSession, root: str, recursive: bool = True, files: Files | None = None) -> DataFrame:
    """Bins below a folder, bins without rows too; ``recursive=False`` lists only its own files."""
    return bins_from_paths(list_files(spark, root, "*.adc", recursive, files=files))


def points_from_rows(rows: DataFrame, column_map: dict[str, str], bin_id: Column) -> DataFrame:
    """Name and type raw instrument columns.

    ``column_map`` gives an SQL expression over the raw columns for each of
    seq, trigger_id, x, y and has_roi.
    """
    types = {"seq": "bigint", "trigger_id": "bigint", "x": "double", "y": "double", "has_roi": "boolean"}
    return rows.select(
        bin_id.alias("bin_id"), *[F.expr(column_map[name]).cast(kind).alias(name) for name, kind in types.items()]
    )


def read_lines(paths: DataFrame, files: Files | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, line) of the listed files: rows (path, size) in, one row per line out. Blank lines are dropped.

    Only listed files are opened. A file is cut into byte ranges that are dealt over the tasks, so one very long file is
    no single task; a line belongs to the range it begins in. A file that cannot be read is an error.
    """
    files = files or Files()
    parts = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long")))
    ranges = paths.where(F.col("size") > 0).select("path", begin.alias("begin")).repartition(parts, "path", "begin")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, begin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with files.open(path) as stream:
                    for lines in _lines_of(stream, begin, begin + split_bytes):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(lines), path, object), pa.string()), pa.array(lines, pa.string())], ["path", "line"]
                        )

    return ranges.mapInArrow(read, "path string, line string")


def _lines_of(stream: pa.NativeFile, begin: int, end: int) -> Iterator[list[str]]:
    """Lines that begin in [begin, end) of a stream; they end at LF, CR LF or the end of the stream."""
    # From the byte before: a line that begins just here is ours, and the rest of an earlier one is not.
    at, skipping, rest = max(begin - 1, 0), begin > 0, b""
    stream.seek(at)
    while True:
        block = stream.read(BLOCK_BYTES)
        lines = (rest + block).split(b"\n")
        rest = lines.pop() if block else b""
        kept = []
        for line in lines:
            if at >= end:
                break
            if skipping:
                skipping = False
            elif text_of := line.removesuffix(b"\r"):
                kept.append(text_of.decode("utf-8", "replace"))
            at += len(line) + 1
        if kept:
            yield kept
        if not block or at >= end:
            return


def scan_points(
    spark: SparkSession,
    root: str,
    column_map: dict[str, str],
    columns: int,
    recursive: bool = True,
    ids: DataFrame | list[str] | None = None,
    days: list[str] | None = None,
    files: Files | None = None,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """Point rows of the ``.adc`` files below a folder, bin_id from the file name.

    ``ids`` (None or empty: all) and ``days`` (``yyyy-MM-dd``; None: all) choose bins by name before any
    file is opened. The raw files have no header; ``columns`` fields are text ``_c0``... and only the mapped ones are
    parsed. A row with fewer fields has NULL in the rest.
    """
    listed = list_files(spark, root, "*.adc", recursive, files=files)
    bin_id = F.regexp_replace(text.file_name(F.col("path")), "[.]adc$", "")
    chosen = select_units(listed.select(bin_id.alias("bin_id"), "path", "size"), ids)
    if days is not None:
        chosen = chosen.where(text.pid_fields(F.col("bin_id"))[2].cast("string").isin(*days))
    schema = ", ".join(f"_c{i} string" for i in range(columns))
    lines = read_lines(chosen, files, split_bytes)
    raw = lines.select(bin_id.alias("bin_id"), F.from_csv("line", schema).alias("_r")).select("bin_id", "_r.*")
    return points_from_rows(raw, column_map, F.col("bin_id"))


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Identifiers from text, one per line; blank lines are dropped."""
    lines = spark.read.text(path).select(F.trim("value").alias("bin_id"))
    return lines.filter(F.col("bin_id") != "")


def write_id_list(bins: DataFrame, bin_type: str, path: str) -> int:
    """Write identifiers of one type, one per line, and return how many.

    Nothing is written when there are none.
    """
    ids = filter_bin_type(bins, bin_type).select("bin_id")
    count = ids.count()
    if count:
        ids.write.mode("overwrite").text(path)
    return count


def day_layout(bin_id: Column, root: str) -> dict[str, Column]:
    """Output paths of a bin by day: feature table, multi-blob table and mask archive.

    A bin whose name holds no day goes to the folder ``undated``.
    """
    day = F.coalesce(F.date_format(text.pid_fields(bin_id)[2], "yyyy-MM-dd"), F.lit("undated"))
    # Folder and file names of the layout.
    return {
        "features": F.concat(F.lit(f"{root}/features/"), day, F.lit("/"), bin_id, F.lit("_features_v4.csv")),
        "multiblob": F.concat(F.lit(f"{root}/features/"), day, F.lit("/multiblob/"), bin_id, F.lit("_multiblob_v4.csv")),
        "blobs": F.concat(F.lit(f"{root}/blobs/"), day, F.lit("/"), bin_id, F.lit("_blobs_v4.zip")),
    }


def write_day_layout(
    features: DataFrame,
    multiblob: DataFrame,
    root: str,
    masks: DataFrame | None = None,
    order_by: tuple[str, ...] = (),
    files: Files | None = None,
) -> DataFrame:
    """Write each bin's feature rows, multi-blob rows and mask archive to its files of the day layout.

    The tables have bin_id and any columns, rows in the order of ``order_by``; ``masks`` has bin_id, member, and path or content. Returns
    a status row per file: out_path, ok, error, rows, bytes. All has been written when this returns, once.
    """
    place = lambda df, kind: df.withColumn("out_path", day_layout(F.col("bin_id"), root)[kind])
    status = write_named(place(features, "features"), root, order_by, files=files)
    status = status.unionByName(write_named(place(multiblob, "multiblob"), root, order_by, files=files))
    if masks is not None:
        status = status.unionByName(write_zips(place(masks, "blobs").drop("bin_id"), root, files))
    return status


def write_partitioned(df: DataFrame, root: str) -> None:
    """CSV folders by day and bin, for stores without a mount. An ordinary bin is one file."""
    dated = df.select("*", text.pid_fields(F.col("bin_id"))[2])
    lay_out(dated, ["day", "bin_id"]).write.mode("overwrite").partitionBy("day", "bin_id").option("header", True).csv(root)
