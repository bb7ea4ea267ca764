"""Media files: discovery, validation, the media store and bin archives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binflow.functions import text
from binflow.sources.named import write_zips
from binflow.sources.store import Files, list_files

# Leading bytes (hex, as SQL LIKE patterns) of the media types.
SIGNATURES = {
    ".jpg": ["FFD8FF%"],
    ".jpeg": ["FFD8FF%"],
    ".png": ["89504E47%"],
    ".bmp": ["424D%"],
    ".tif": ["49492A00%", "4D4D002A%"],
    ".tiff": ["49492A00%", "4D4D002A%"],
    ".webp": ["52494646________57454250%"],
    ".avi": ["52494646________41564920%"],
}
HEAD_BYTES = 16
# Reasons a file is skipped, in the order of the checks.
EMPTY = "empty file (0 bytes)"
BAD_IMAGE = "cannot read image"
BAD_VIDEO = "cannot open"
NO_FRAMES = "no frames detected"
BAD_FRAME = "cannot read first frame"


def discover_media(files: DataFrame, ext: str = ".avi", max_files: int | None = None) -> DataFrame:
    """Files whose path ends in ``ext``; with ``max_files`` the first ones by path."""
    found = files.filter(F.col("path").endswith(ext))
    return found if max_files is None else found.orderBy("path").limit(max_files)


def scan_media(
    spark: SparkSession, root: str, ext: str = ".avi", max_files: int | None = None, files: Files | None = None, heads: bool = False
) -> DataFrame:
    """Media files below a folder of any store: path and size, with ``heads`` also the bytes that validation looks at.

    With ``max_files`` only the heads of the chosen files are read.
    """
    if max_files is None:
        return discover_media(list_files(spark, root, f"*{ext}", head=HEAD_BYTES if heads else None, files=files), ext)
    found = discover_media(list_files(spark, root, f"*{ext}", files=files), ext, max_files)
    return read_heads(found, files) if heads else found


def read_heads(paths: DataFrame, files: Files | None = None) -> DataFrame:
    """Adds ``head``: the first bytes of each file, NULL when it cannot be read.

    Only these bytes are read, not the file. A store that cannot be opened is an error, not a file that cannot be read.
    """
    files = files or Files()

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(head=[files.head(path, HEAD_BYTES) for path in pdf["path"]])

    schema = ", ".join(f"`{name}` {kind}" for name, kind in paths.dtypes)
    return paths.mapInPandas(heads, f"{schema}, head binary")


def validate_media(files: DataFrame, skip_validation: bool = False) -> DataFrame:
    """Adds valid, reason and frame_count; the first failed check names the reason.

    Input: path, size, head, and for videos optionally frame_count and
    first_frame_ok as a decoder reports them. Decoding itself is the caller's.
    """
    frames = F.col("frame_count") if "frame_count" in files.columns else F.lit(None)
    first = F.col("first_frame_ok") if "first_frame_ok" in files.columns else F.lit(None)
    columns = [c for c in files.columns if c not in ("frame_count", "first_frame_ok", "head")]
    if skip_validation:
        return files.select(*columns, F.lit(True).alias("valid"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("int").alias("frame_count"))
    ending = F.lower(text.suffix(F.col("path")))
    start = F.hex("head")
    known = F.lit(True)
    for name, patterns in SIGNATURES.items():
        matches = F.lit(False)
        for pattern in patterns:
            matches = matches | start.like(pattern)
        known = F.when(ending == name, matches).otherwise(known)
    readable = F.col("head").isNotNull() & F.coalesce(known, F.lit(False))
    image = text.is_image(ending)
    reason = (
        F.when(F.col("size") == 0, EMPTY)
        .when(image & ~readable, BAD_IMAGE)
        .when(image, None)
        .when(~readable, BAD_VIDEO)
        .when(frames <= 0, NO_FRAMES)
        .when(~first, BAD_FRAME)
    )
    return files.withColumn("reason", reason).select(
        *columns,
        F.col("reason").isNull().alias("valid"),
        "reason",
        F.when(F.col("reason").isNull() & ~image, frames).cast("int").alias("frame_count"),
    )


def media_put(files: DataFrame) -> DataFrame:
    """(key, payload) of files given as path and content: file name and base64 text."""
    return files.select(text.file_name(F.col("path")).alias("key"), text.base64_text(F.col("content")).alias("payload"))


def media_get(keys: DataFrame, store: DataFrame) -> DataFrame:
    """(key, content) of the wanted keys."""
    return store.join(keys.select("key"), "key", "left_semi").select("key", F.unbase64("payload").alias("content"))


def archive_bins(
    members: DataFrame, folder: str, prefix: str = "", ending: str = ".zip", files: Files | None = None
) -> DataFrame:
    """One zip per bin at ``<folder>/<prefix><bin_id><ending>``; returns a status row per bin.

    Input: bin_id, member and path (the file is read in the task) or content. A
    zip is one stream, so a bin has one writer; members pass through it in order
    and are never held together. A failed bin gives its error and the rest go on. ``folder`` may be in
    any store. The archives are there when this returns; reading the status writes nothing.
    """
    key = F.concat(F.lit(prefix), F.col("bin_id"), F.lit(ending))
    root = Files.plain(folder)
    source = "path" if "path" in members.columns else "content"
    placed = members.select(F.concat(F.lit(f"{root}/"), key).alias("out_path"), "member", source)
    object_key = F.substr("out_path", F.lit(len(root) + 2))
    bin_id = F.substr(object_key, F.lit(len(prefix) + 1), F.char_length(object_key) - len(prefix) - len(ending))
    status = write_zips(placed, root, files)
    return status.select(bin_id.alias("bin_id"), "ok", "error", object_key.alias("object_key"), F.col("rows").alias("members"), "bytes")
