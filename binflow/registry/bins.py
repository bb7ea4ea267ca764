"""Bins, identifiers and their restrictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from binflow.bindings import load
from binflow.functions import text
from binflow.operators import select
from binflow.registry import query
from binflow.registry.rounding import rounded
from binflow.session import scratch_path
from binflow.sources import bins as io
from binflow.sources.named import write_named
from binflow.sources.store import Files


@query(
    "scan_bins",
    "select regexp_extract(path, '([^/]+)[.]adc$', 1) as bin_id, substr(split_part(path, '/', 4), 1, 1) as bin_type, path from {bins}",
)
def scan_bins(spark, sf):
    """Writes a file for each bin, in folders as the paths name them, and lists them."""
    root = scratch_path(spark, "bins")
    place = lambda path: F.concat(F.lit(root), F.substr(path, F.lit(len("/data") + 1)))
    write_named(load(spark, sf, "bins").select(F.col("bin_id").alias("line"), place(F.col("path")).alias("out_path")), root)
    below = F.substr("path", F.lit(len(Files.plain(root)) + 1))
    return io.scan_bins(spark, root).select("bin_id", "bin_type", F.concat(F.lit("/data"), below).alias("path"))


_RAW = {
    "seq": "bigint(_c0)",
    "trigger_id": "bigint(_c1)",
    "x": "double(_c2) / 105000 * 1.36d",
    "y": "double(_c3) / 50",
    "has_roi": "_c4 <> 'N'",
}
_RAW_SQL = """select concat('S', cast(l_suppkey as string)) as bin_id, l_linenumber::bigint as seq, l_orderkey as trigger_id,
              round(l_extendedprice / 105000e0 * 1.36e0, 6) as x, round(l_quantity / 50e0, 6) as y, l_returnflag <> 'N' as has_roi
       from {lineitem}"""


def _point_files(spark, sf) -> str:
    """Folder of headerless instrument files, one per supplier."""
    root = scratch_path(spark, "points")
    line = F.concat_ws(",", "l_linenumber", "l_orderkey", "l_extendedprice", "l_quantity", "l_returnflag")
    path = F.concat(F.lit(f"{root}/run/S"), "l_suppkey", F.lit(".adc"))
    write_named(load(spark, sf, "lineitem").select(line.alias("line"), path.alias("out_path")), root)
    return root


@query("scan_points", _RAW_SQL)
def scan_points(spark, sf):
    """Writes the point rows as instrument files, then scans them back in small byte ranges."""
    return rounded(io.scan_points(spark, _point_files(spark, sf), _RAW, 5, split_bytes=50_000))


@query("scan_points_listed", _RAW_SQL + " where l_suppkey % 3 = 0")
def scan_points_listed(spark, sf):
    """Only the files of the listed bins are opened."""
    suppliers = load(spark, sf, "supplier").where("s_suppkey % 3 = 0")
    ids = suppliers.select(F.concat(F.lit("S"), "s_suppkey").alias("bin_id"))
    return rounded(io.scan_points(spark, _point_files(spark, sf), _RAW, 5, ids=ids))


@query("read_id_list", "select bin_id from {bins}")
def read_id_list(spark, sf):
    path = scratch_path(spark, "ids")
    load(spark, sf, "bins").select(F.explode(F.array(F.concat(F.lit(" "), "bin_id"), F.lit("")))).write.text(path)
    return io.read_id_list(spark, path)


@query("write_id_list", "select bin_id from {bins} where bin_type = 'I'")
def write_id_list(spark, sf):
    path = scratch_path(spark, "ids")
    io.write_id_list(load(spark, sf, "bins"), "I", path)
    return io.read_id_list(spark, path)


@query("filter_bin_type", "select bin_id, bin_type, path from {bins} where starts_with(bin_id, 'D')")
def filter_bin_type(spark, sf):
    return select.filter_bin_type(load(spark, sf, "bins"), "D")


@query(
    "select_units",
    """select bin_id, count(*) as points from {points}
       where bin_id in (select bin_id from {bins} where path like '/data/1/%') group by bin_id""",
)
def select_units(spark, sf):
    listed = load(spark, sf, "bins").filter(F.col("path").startswith("/data/1/"))
    kept = select.select_units(load(spark, sf, "points"), listed)
    return kept.groupBy("bin_id").agg(F.count(F.lit(1)).alias("points"))


@query(
    "training_ids",
    """select 'by type' as choice, bin_id from {bins} where starts_with(bin_id, 'I')
       union all select 'by list', bin_id from {bins} where path like '/data/2/%'""",
)
def training_ids(spark, sf):
    bins = load(spark, sf, "bins")
    listed = bins.filter(F.col("path").startswith("/data/2/"))
    by_type = select.training_ids(bins, None, "I").select(F.lit("by type").alias("choice"), "bin_id")
    return by_type.unionByName(select.training_ids(bins, listed, "I").select(F.lit("by list").alias("choice"), "bin_id"))


@query(
    "parse_pid",
    """select unit, pid, strftime(try_strptime(pid[2:16], '%Y%m%dT%H%M%S'), '%Y-%m-%d %H:%M:%S') as acquired_at,
              regexp_extract(pid, 'IFCB[0-9]+$') as instrument,
              strftime(try_strptime(pid[2:16], '%Y%m%dT%H%M%S'), '%Y-%m-%d') as day
       from {pids}""",
)
def parse_pid(spark, sf):
    parsed = select.parse_pid(load(spark, sf, "pids"), "pid")
    return parsed.select("unit", "pid", F.date_format("acquired_at", "yyyy-MM-dd HH:mm:ss").alias("acquired_at"), "instrument", F.col("day").cast("string"))


@query("count_bins_by_type", "select bin_type, count(*) as bins from {bins} group by bin_type")
def count_bins_by_type(spark, sf):
    return select.count_bins_by_type(load(spark, sf, "bins"))


@query(
    "templated_output",
    """select bin_id, concat('net-v1/', split_part(path, '/', 3), '/', bin_id, '.csv') as by_model,
              concat('2024-05-01/', split_part(path, '/', 3), '/', bin_id, '.emb.parquet') as by_date,
              concat('out/', bin_id, '/net-v1.csv') as explicit from {bins}""",
)
def templated_output(spark, sf):
    model, date = F.lit("net-v1"), F.lit("2024-05-01")
    sub, bin_id = F.split_part("path", F.lit("/"), F.lit(3)), F.col("bin_id")
    return load(spark, sf, "bins").select(
        "bin_id",
        text.output_path(None, "model-name", False, model, date, sub, bin_id).alias("by_model"),
        text.output_path(None, "run-date", True, model, date, sub, bin_id).alias("by_date"),
        text.output_path("out/{BIN}/{MODEL_NAME}.csv", "run-date", False, model, date, sub, bin_id).alias("explicit"),
    )


@query(
    "plot_label",
    """select concat('evaluation_bad_', lower(kind), '_vs_', lower(replace(concat('Not Known ', c_mktsegment), ' ', '_')),
              '_', kind, '_bins.png') as plot, count(*) as customers
       from (select c_mktsegment, case when c_custkey % 2 = 0 then 'D' else 'I' end as kind from {customer}) group by all""",
)
def plot_label(spark, sf):
    kind = F.when(F.col("c_custkey") % 2 == 0, "D").otherwise("I")
    plot = text.plot_file(
        F.concat(F.lit("bad_"), F.lower(kind)),
        F.concat(F.lit("Not Known "), F.col("c_mktsegment")),
        F.concat(kind, F.lit("_bins")),
    )
    return load(spark, sf, "customer").groupBy(plot.alias("plot")).agg(F.count(F.lit(1)).alias("customers"))


@query(
    "parse_int_list",
    """select l_orderkey, l_linenumber, l_partkey,
              case when l_linenumber % 7 = 0 then 'all' else concat(l_orderkey, '+', l_partkey) end as ids from {lineitem}""",
)
def parse_int_list(spark, sf):
    joined = F.concat(F.col("l_orderkey"), F.lit(",, "), F.col("l_partkey"), F.lit(","))
    none = F.when(F.col("l_orderkey") % 3 == 0, "None").when(F.col("l_orderkey") % 3 == 1, "")
    listed = F.when(F.col("l_linenumber") % 7 == 0, none).otherwise(joined)
    ids = F.coalesce(F.array_join(text.parse_int_list(listed), "+"), F.lit("all"))
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", ids.alias("ids"))


@query(
    "parse_bool",
    """select l_returnflag, l_linestatus, case when l_returnflag = 'N' then cast(l_linestatus = 'O' as varchar) else 'invalid' end as flag, count(*) as n
       from {lineitem} group by all""",
)
def parse_bool(spark, sf):
    shown = F.when(F.col("l_linestatus") == "O", "True").otherwise("False")
    option = F.when(F.col("l_returnflag") == "N", shown).otherwise(F.lower(shown))
    return (
        load(spark, sf, "lineitem")
        .groupBy("l_returnflag", "l_linestatus", F.coalesce(text.try_parse_bool(option).cast("string"), F.lit("invalid")).alias("flag"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


_LAYOUT_SQL = """with d as (select pid, unit, strftime(try_strptime(pid[2:16], '%Y%m%dT%H%M%S'), '%Y-%m-%d') as day, pid[1:9] as stem from {pids})"""


def _day_rows(spark, sf):
    """Ten bins a day: the identifiers' days, with the last digit of the unit as instrument."""
    bin_id = F.concat(F.substring("pid", 1, 9), F.lit("T000000_IFCB00"), F.col("unit") % 10)
    return load(spark, sf, "pids").select(bin_id.alias("bin_id"), "pid", "unit")


@query(
    "write_day_layout",
    _LAYOUT_SQL
    + """ select concat('features/', day, f.folder, stem, 'T000000_IFCB00', unit % 10, f.ending) as file, count(*) as rows
          from d, (values ('/', '_features_v4.csv'), ('/multiblob/', '_multiblob_v4.csv')) f(folder, ending) group by all
          union all select concat('blobs/', day, '/', stem, 'T000000_IFCB00', unit % 10, '_blobs_v4.zip'), count(*) from d group by all""",
)
def write_day_layout(spark, sf):
    root = scratch_path(spark, "days")
    rows = _day_rows(spark, sf)
    masks = rows.select("bin_id", F.col("unit").cast("string").alias("member"), F.col("pid").alias("content"))
    status = io.write_day_layout(rows, rows, root, masks, ("unit",)).filter("ok")
    return status.select(F.substr("out_path", F.lit(len(Files.plain(root)) + 2)).alias("file"), "rows")


@query("write_partitioned", _LAYOUT_SQL + " select day, concat(stem, 'T000000_IFCB00', unit % 10) as bin_id, pid, unit from d")
def write_partitioned(spark, sf):
    root = scratch_path(spark, "days")
    io.write_partitioned(_day_rows(spark, sf), root)
    return spark.read.option("header", True).schema("pid string, unit bigint, day string, bin_id string").csv(root)
