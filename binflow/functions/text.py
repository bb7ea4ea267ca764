"""Column expressions on identifiers, paths and option texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from binflow.params import IMAGE_SUFFIXES

# Fixed value: shape of the identifiers that carry a date, with the instrument after it.
PID_PATTERN = r"^D([0-9]{8}T[0-9]{6})_(IFCB[0-9]+)$"

# Output name patterns by sub-folder type.
SCORE_PATTERNS = {"model-name": "{MODEL_NAME}/{SUBPATH}/{BIN}.csv", "run-date": "{RUN_DATE}/{SUBPATH}/{BIN}.csv"}
EMBEDDING_PATTERNS = {
    "model-name": "{MODEL_NAME}/{SUBPATH}/{BIN}.emb.parquet",
    "run-date": "{RUN_DATE}/{SUBPATH}/{BIN}.emb.parquet",
}


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def base_name(path: Column) -> Column:
    """File name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(file_name(path), r"^([.]*[^.].*)[.][^.]*$", "$1")


def suffix(path: Column) -> Column:
    """Last extension with its dot, or an empty string."""
    return F.regexp_extract(file_name(path), r"[^.]([.][^.]+)$", 1)


def is_image(path_suffix: Column) -> Column:
    return F.lower(path_suffix).isin(*IMAGE_SUFFIXES)


def media_kind(path: Column) -> Column:
    return F.when(is_image(suffix(path)), "image").otherwise("video")


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root``, else the bare file name."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))).otherwise(file_name(path))


def pid_fields(pid: Column) -> list[Column]:
    """Acquisition time, instrument and day of a dated identifier, NULL for others."""
    stamp = F.nullif(F.regexp_extract(pid, PID_PATTERN, 1), F.lit(""))
    at = F.try_to_timestamp(stamp, F.lit("yyyyMMdd'T'HHmmss"))
    instrument = F.nullif(F.regexp_extract(pid, PID_PATTERN, 2), F.lit(""))
    return [
        at.cast("timestamp_ntz").alias("acquired_at"),
        F.when(at.isNotNull(), instrument).alias("instrument"),
        at.cast("date").alias("day"),
    ]


def plot_label(name: Column) -> Column:
    return F.lower(F.replace(name, F.lit(" "), F.lit("_")))


def plot_file(bad: Column, normal: Column, scope: Column) -> Column:
    """Evaluation file name for a pair of score sets."""
    return F.format_string("evaluation_%s_vs_%s_%s.png", bad, plot_label(normal), scope)


def output_path(
    pattern: str | None,
    subfolder_type: str,
    embeddings: bool,
    model: Column,
    run_date: Column,
    subpath: Column,
    bin_id: Column,
) -> Column:
    """Fill an output name pattern; an explicit pattern wins over the sub-folder type."""
    table = EMBEDDING_PATTERNS if embeddings else SCORE_PATTERNS
    out = F.lit(pattern if pattern is not None else table.get(subfolder_type, table["model-name"]))
    for name, value in (("{MODEL_NAME}", model), ("{RUN_DATE}", run_date), ("{SUBPATH}", subpath), ("{BIN}", bin_id)):
        out = F.replace(out, F.lit(name), value)
    return out


def parse_int_list(text: Column) -> Column:
    """``"1,2"`` to integers. NULL, empty and ``none`` give NULL; blank parts are skipped."""
    parts = F.filter(F.split(text, ","), lambda part: F.trim(part) != "")
    numbers = F.transform(parts, lambda part: F.trim(part).cast("int"))
    return F.when(text.isNull() | (text == "") | (F.lower(text) == "none"), None).otherwise(numbers)


def try_parse_bool(text: Column) -> Column:
    return F.when(text == "True", True).when(text == "False", False)


def parse_bool(text: Column) -> Column:
    """Exactly ``True`` or ``False``; anything else fails the query."""
    problem = F.concat(F.lit("expected True or False, got "), F.coalesce(text, F.lit("NULL")))
    return F.when(text == "True", True).when(text == "False", False).otherwise(F.raise_error(problem).cast("boolean"))


def base64_text(content: Column) -> Column:
    """Base64 without line breaks."""
    return F.translate(F.base64(content), "\r\n", "")
