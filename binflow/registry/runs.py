"""Resumable runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from binflow.bindings import load
from binflow.operators import runs as ops
from binflow.operators.select import pending, pending_counts
from binflow.plans.resume import plan_run, resume_run
from binflow.registry import query
from binflow.registry.media import HEADS_SQL, REASON_SQL, with_heads
from binflow.registry.rounding import rounded
from binflow.session import scratch_path
from binflow.sources import manifest as manifests


@query("pending", "select path, size, suffix, doc_id from {files} where path not in (select path from {manifest})")
def pending_files(spark, sf):
    return pending(load(spark, sf, "files"), load(spark, sf, "manifest")).select("path", "size", "suffix", "doc_id")


@query("pending_ledger", "select path, doc_id from {files} where path not in (select path from {manifest})")
def pending_ledger(spark, sf):
    """The manifest as a bucketed ledger: several runs, some files tried twice, compacted in between."""
    path = scratch_path(spark, "ledger")
    ledger = manifests.Ledger(spark, path, buckets=8)
    done = load(spark, sf, "manifest").distinct()
    ledger.append(done.withColumn("ok", F.lit(False)), "first")
    ledger.append(done.withColumn("ok", F.lit(True)), "second")
    ledger.compact()
    ledger.append(load(spark, sf, "files").join(done, "path", "left_anti").withColumn("ok", F.lit(False)), "third")
    return manifests.Ledger(spark, path).pending(load(spark, sf, "files")).select("path", "doc_id")


@query(
    "pending_counts",
    """select count(*) as found, count(*) filter (path in (select path from {manifest})) as complete,
              count(*) filter (path not in (select path from {manifest})) as to_do from {files}""",
)
def counts(spark, sf):
    return pending_counts(load(spark, sf, "files"), load(spark, sf, "manifest"))


@query("manifest", "select distinct path from {manifest}")
def manifest(spark, sf):
    """Appends the same finished files twice and reads them back once."""
    path = scratch_path(spark, "manifest")
    done = load(spark, sf, "manifest").withColumn("ok", F.lit(True))
    for run in ("first", "second"):
        manifests.append_manifest(done, path, run)
    return manifests.read_manifest(spark, path)


_CHUNKS = """numbered as (select path, row_number() over (order by path) as rn, count(*) over () as n from {files}),
    chunked as (select path, ((rn - 1) // ceil(n / least(7, n))::bigint) as chunk from numbered)"""


@query("contiguous_chunks", f"with {_CHUNKS} select path, chunk from chunked")
def contiguous_chunks(spark, sf):
    return ops.contiguous_chunks(load(spark, sf, "files").select("path"), 7)


@query(
    "batches",
    f"""with {_CHUNKS} select path, chunk, ((row_number() over (partition by chunk order by path) - 1) // 40)::bigint as batch
        from chunked where path not in (select path from {{manifest}})""",
)
def batches(spark, sf):
    chunked = ops.contiguous_chunks(load(spark, sf, "files").select("path"), 7)
    return ops.batches(pending(chunked, load(spark, sf, "manifest")), 40)


_PLAN = f"""heads as ({HEADS_SQL}),
    valid as (select path from heads where path like '%.avi' and ({REASON_SQL}) is null),
    numbered as (select path, row_number() over (order by path) as rn, count(*) over () as n from valid),
    chunked as (select path, ((rn - 1) // ceil(n / least(4, n))::bigint) as chunk from numbered),
    todo as (select * from chunked where path not in (select path from {{manifest}}))"""


@query(
    "plan_run",
    f"with {_PLAN} select path, chunk, ((row_number() over (partition by chunk order by path) - 1) // 25)::bigint as batch from todo",
)
def plan(spark, sf):
    return plan_run(with_heads(spark, sf), load(spark, sf, "manifest"), workers=4, batch_size=25)


def _process(paths: list[str]) -> None:
    bad = [p for p in paths if p.removesuffix(".avi").endswith("7")]
    if bad:
        raise ValueError(f"cannot process {bad[0]}")


def _stage(path: str) -> str:
    if path.removesuffix(".avi").endswith("4"):
        raise OSError(f"cannot stage {path}")
    return path


@query(
    "run_batches",
    f"""with {_PLAN} select path, substr(path, -5, 1) not in ('4', '7') as ok,
        case substr(path, -5, 1) when '4' then concat('cannot stage ', path) when '7' then concat('cannot process ', path) else 'none' end as error
        from todo""",
)
def run_batches(spark, sf):
    """Files ending in 4 cannot be staged and files ending in 7 fail; the others of their batch go through."""
    todo = plan_run(with_heads(spark, sf), load(spark, sf, "manifest"), workers=4, batch_size=25)
    status = resume_run(todo, scratch_path(spark, "manifest"), "run", _process, _stage)
    return status.fillna("none", ["error"])


@query(
    "run_summary",
    """select run_id, count(*) as total, count(*) filter (ok) as succeeded, count(*) filter (not ok) as failed,
              count(*) filter (not ok) > 0 and count(*) filter (ok) = 0 as archive_run_failed,
              count(*) filter (not ok) > 0 or count(*) filter (ok) = 0 as inference_run_failed from {status} group by run_id""",
)
def run_summary(spark, sf):
    return ops.run_summary(load(spark, sf, "status"), ["run_id"])


@query("failed_units", "select run_id, unit_id, error from {status} where not ok")
def failed_units(spark, sf):
    return ops.failed_units(load(spark, sf, "status")).select("run_id", "unit_id", "error")


@query(
    "run_progress",
    """with n as (select run_id, finished_at, row_number() over (partition by run_id order by finished_at, unit_id) as processed,
                  count(*) over (partition by run_id) as total, min(finished_at) over (partition by run_id) as start from {status}),
            t as (select *, (epoch_us(finished_at) - epoch_us(start)) / 1e6 as seconds from n where processed % 10 = 0),
            r as (select *, coalesce(processed / nullif(seconds, 0), 0) as rate from t)
       select run_id, processed, total, round(100e0 * processed / total, 6) as percent, round(rate, 6) as units_per_second,
              round(coalesce((total - processed) / nullif(rate, 0), 0), 3) as eta_seconds from r""",
)
def run_progress(spark, sf):
    progress = ops.run_progress(load(spark, sf, "status"))
    return rounded(progress.withColumn("eta_seconds", F.round("eta_seconds", 3)))
