"""Score tables: CSV in and out, union by name."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binflow.functions import text
from binflow.sources.store import Files

log = logging.getLogger(__name__)
#: Bytes that are read at a time until a header ends.
HEADER_BLOCK = 4096
_WIDER = ["int", "bigint", "double", "string"]


def read_score_csvs(
    spark: SparkSession, paths: list[str], add_source: bool = False, files: Files | None = None
) -> DataFrame | None:
    """Union of header CSV files; missing, unreadable and empty ones are skipped with a warning.

    One job reads the first line of each file. Files of the same header are read together, so jobs, scans and branches of the union
    grow with the different headers and not with the files. A listed folder is a table of its own, read by itself. A column has the
    type that fits all its values. A path listed twice counts twice. None when nothing could be read.
    """
    headers = read_headers(spark, paths, files) if paths else {}
    groups: dict[tuple, list[str]] = {}
    times: dict[str, int] = {}
    for path in paths:
        header, problem, folder = headers[path]
        if problem is not None:
            log.warning("score file is skipped: %s (%s)", path, problem)
            continue
        times[path] = times.get(path, 0) + 1
        groups.setdefault((header, times[path], path if folder else None), []).append(path)
    frames = []
    for (_, _, folder), group in groups.items():
        df = spark.read.option("header", True).option("inferSchema", True).csv(group)
        # Names in metadata are URIs.
        name = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        if folder is not None:
            name = F.lit(Files.plain(folder))
        frames.append(df.select("*", text.base_name(name).alias("source_file")) if add_source else df)
    return merge_scores(frames) if frames else None


def read_headers(
    spark: SparkSession, paths: list[str], files: Files | None = None
) -> dict[str, tuple[str | None, str | None, bool]]:
    """(first line, problem, is a folder) of each listed file, read by tasks from its beginning; a folder has the line of its first file."""
    files = files or Files()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_header(files, path) for path in batch.column(0).to_pylist()]
            kinds = (pa.string(), pa.string(), pa.bool_())
            columns = [batch.column(0), *(pa.array(list(c), kind) for c, kind in zip(zip(*rows), kinds))]
            yield pa.RecordBatch.from_arrays(columns, ["path", "header", "problem", "folder"])

    listed = spark.createDataFrame([(p,) for p in dict.fromkeys(paths)], "path string")
    found = listed.mapInArrow(read, "path string, header string, problem string, folder boolean").collect()
    return {r.path: (r.header, r.problem, r.folder) for r in found}


def _header(files: Files, path: str) -> tuple[str | None, str | None, bool]:
    folder, line = False, b""
    try:
        folder = files.is_folder(path)
        if folder:
            inside = [(uri, size) for uri, is_folder, size in files.entries(path) if not is_folder]
            shown = sorted(uri for uri, size in inside if size and uri.rsplit("/", 1)[-1][0] not in "._")
            if not shown:
                return None, "empty", True
            path = shown[0]
        with files.open(path) as stream:
            while b"\n" not in line and (block := stream.read(HEADER_BLOCK)):
                line += block
    except (OSError, ValueError) as problem:
        return None, str(problem) or type(problem).__name__, folder
    line = line.split(b"\n", 1)[0].removesuffix(b"\r")
    return (line.decode("utf-8", "replace"), None, folder) if line else (None, "empty", folder)


def merge_scores(frames: list[DataFrame]) -> DataFrame:
    """All rows of all tables; columns match by name, absent ones are NULL.

    A column typed differently in two tables takes the wider type.
    """
    types: dict[str, str] = {}
    for frame in frames:
        for name, kind in frame.dtypes:
            seen = types.setdefault(name, kind)
            if seen != kind:
                both = {seen, kind}
                types[name] = next((w for w in _WIDER if both <= set(_WIDER[: _WIDER.index(w) + 1])), "string")
    cast = [f.select(*[F.col(name).cast(types[name]).alias(name) for name in f.columns]) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def write_scores(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").option("header", True).csv(path)
