"""Resumable run: discover, validate, cut into chunks, skip finished files, batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from binflow.operators.runs import batches, contiguous_chunks, run_batches
from binflow.operators.select import pending
from binflow.session import materialize
from binflow.sources.manifest import append_manifest, pending_paths
from binflow.sources.media import discover_media, validate_media


def plan_run(
    files: DataFrame,
    manifest: DataFrame,
    workers: int,
    batch_size: int = 1000,
    ext: str = ".avi",
    max_files: int | None = None,
    skip_validation: bool = False,
) -> DataFrame:
    """(path, chunk, batch) of the files still to do.

    Chunks are cut over all valid files; finished files leave their chunk
    afterwards, so a re-run keeps the chunk of every file.
    """
    found = discover_media(files, ext, max_files)
    valid = validate_media(found, skip_validation).filter("valid").select("path")
    return batches(pending(contiguous_chunks(valid, workers), manifest), batch_size)


def resume_run(
    plan: DataFrame, manifest_path: str, run_id: str, process: Callable[[list[str]], None], stage: Callable[[str], str] | None = None
) -> DataFrame:
    """Run a plan and append the finished files to the manifest; returns the status rows.

    The status is written as a table, so the caller's function does not run again when
    the status is read. Files finished meanwhile are left out.
    """
    todo = pending_paths(plan, manifest_path)
    status = materialize(run_batches(todo, process, stage))
    append_manifest(status, manifest_path, run_id)
    return status
