"""Media files, archives and the media store."""

from __future__ import annotations

from pyspark.sql import functions as F

from binflow.bindings import load
from binflow.functions import text
from binflow.operators.catalog import dataset_catalog
from binflow.operators.runs import skip_reasons
from binflow.registry import query
from binflow.session import scratch_path
from binflow.sources import media as io
from binflow.sources.named import write_named

# Leading bytes as hex: right for two files of three, else the start of the document's text.
_HEADS = {".jpg": "FFD8FFE0", ".PNG": "89504E470D0A1A0A", ".tif": "49492A0008000000", ".avi": "524946461000000041564920"}
_RIGHT = "case suffix " + " ".join(f"when '{s}' then '{h}'" for s, h in _HEADS.items()) + " end"
HEADS_SQL = f"""select f.*, case when f.doc_id % 3 <> 0 then {_RIGHT} else hex(substr(d.text, 1, 8)) end as head,
    (f.doc_id % 11)::int as frames from {{files}} f join {{documents}} d on f.doc_id = d.doc_id"""
REASON_SQL = """case when size = 0 then 'empty file (0 bytes)'
    when suffix in ('.jpg', '.PNG', '.tif') and doc_id % 3 = 0 then 'cannot read image'
    when suffix in ('.jpg', '.PNG', '.tif') then null
    when doc_id % 3 = 0 then 'cannot open' when frames = 0 then 'no frames detected'
    when frames = 5 then 'cannot read first frame' end"""


def with_heads(spark, sf):
    """Files with leading bytes, frame count and first-frame flag."""
    right = F.lit(None)
    for ending, head in _HEADS.items():
        right = F.when(F.col("suffix") == ending, F.unhex(F.lit(head))).otherwise(right)
    frames = (F.col("doc_id") % 11).cast("int")
    starts = load(spark, sf, "documents").select("doc_id", F.substring("text", 1, 8).cast("binary").alias("start"))
    return load(spark, sf, "files").join(starts, "doc_id").select(
        "path",
        "size",
        "suffix",
        "doc_id",
        F.when(F.col("doc_id") % 3 != 0, right).otherwise(F.col("start")).alias("head"),
        frames.alias("frame_count"),
        (frames != 5).alias("first_frame_ok"),
    )


@query("discover_media", "select path, size from {files} where path like '%.avi' order by path limit 100")
def discover_media(spark, sf):
    return io.discover_media(load(spark, sf, "files").select("path", "size"), ".avi", 100)


@query(
    "validate_media",
    f"""with heads as ({HEADS_SQL}) select path, size, ({REASON_SQL}) is null as valid, coalesce({REASON_SQL}, 'none') as reason,
        coalesce(case when ({REASON_SQL}) is null and suffix = '.avi' then frames end, -1)::int as frame_count from heads""",
)
def validate_media(spark, sf):
    checked = io.validate_media(with_heads(spark, sf))
    return checked.select("path", "size", "valid", "reason", "frame_count").fillna({"reason": "none", "frame_count": -1})


@query("skip_reasons", f"with heads as ({HEADS_SQL}) select coalesce({REASON_SQL}, 'valid') as reason, count(*) as files from heads group by 1")
def reasons(spark, sf):
    return skip_reasons(io.validate_media(with_heads(spark, sf)))


@query("media_kind", "select path, case when lower(suffix) in ('.jpg', '.png', '.tif') then 'image' else 'video' end as kind from {files}")
def media_kind(spark, sf):
    return load(spark, sf, "files").select("path", text.media_kind(F.col("path")).alias("kind"))


@query(
    "relative_path",
    "select path, case when path like '/data/src1/%' then substr(path, 12) else split_part(path, '/', -1) end as relative from {files}",
)
def relative_path(spark, sf):
    return load(spark, sf, "files").select("path", text.relative_path(F.col("path"), "/data/src1").alias("relative"))


def _store(spark, sf):
    pages = load(spark, sf, "media")
    path = F.concat(F.lit("/pages/"), F.col("key"))
    return io.media_put(pages.select(path.alias("path"), F.col("payload").cast("binary").alias("content")))


@query("media_put", "select key, base64(encode(payload)) as payload from {media}")
def media_put(spark, sf):
    return _store(spark, sf)


@query("media_get", "select key, payload as content from {media} where length(payload) % 2 = 0")
def media_get(spark, sf):
    keys = load(spark, sf, "media").filter(F.length("payload") % 2 == 0)
    return io.media_get(keys, _store(spark, sf)).select("key", F.col("content").cast("string"))


@query(
    "archive_bins",
    """select bin_id, true as ok, concat('runs/', bin_id, '.zip') as object_key, count(*) as members, sum(strlen(content))::bigint as bytes
       from {archive_members} group by bin_id""",
)
def archive_bins(spark, sf):
    status = io.archive_bins(load(spark, sf, "archive_members"), scratch_path(spark, "zips"), "runs/")
    return status.select("bin_id", "ok", "object_key", "members", "bytes")


@query(
    "archive_bins_paths",
    """select bin_id, true as ok, concat('runs/', bin_id, '.zip') as object_key, count(*) as members, sum(strlen(content) + 1)::bigint as bytes
       from {archive_members} group by bin_id""",
)
def archive_bins_paths(spark, sf):
    """The members are files, each a line longer than its text; the tasks that write the archives open them."""
    root = scratch_path(spark, "members")
    path = F.concat_ws("/", F.lit(root), "bin_id", "member")
    members = load(spark, sf, "archive_members").select("bin_id", "member", path.alias("path"), "content")
    write_named(members.select(F.col("path").alias("out_path"), "content"), root)
    status = io.archive_bins(members.drop("content"), scratch_path(spark, "zips"), "runs/")
    return status.select("bin_id", "ok", "object_key", "members", "bytes")


@query(
    "dataset_catalog",
    """with named as (select l.split, l.stem, l.class_id, n.n_name from {image_labels} l left join {nation} n on l.class_id = n.n_nationkey)
       select split, 'images' as figure, 'all' as name, count(*) as n from {images} group by split
       union all select split, 'images without label', 'all', count(*) from {images} i
         where not exists (select 1 from {image_labels} l where l.split = i.split and l.stem = i.stem) group by split
       union all select split, 'labels without image', 'all', count(distinct stem) from {image_labels} l
         where not exists (select 1 from {images} i where l.split = i.split and l.stem = i.stem) group by split
       union all select split, 'objects', coalesce(n_name, class_id::varchar), count(*) from named group by all""",
)
def catalog(spark, sf):
    names = load(spark, sf, "nation").select(F.col("n_nationkey").alias("class_id"), F.col("n_name").alias("name"))
    return dataset_catalog(load(spark, sf, "images"), load(spark, sf, "image_labels"), names)
