import zipfile

import pytest
from pyspark.sql import functions as F

from binflow.functions import text
from binflow.operators import catalog, provenance, select
from binflow.sources import bins, manifest, media, scores, tables, vectors
from binflow.sources.named import write_named
from binflow.sources.store import list_files


@pytest.fixture(scope="module")
def run_folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("run")
    for name, rows in (("D20240423T115846_IFCB127", 3), ("deep/I000001", 2), ("deep/er/I000001", 1), ("deep/x.txt", 1)):
        path = root / (name if "." in name else f"{name}.adc")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("".join(f"{i},{i // 2},{i * 0.5},{i * 0.25},{40 * i}\n" for i in range(rows)))
    return str(root)


def test_scan_bins(spark, run_folder):
    found = sorted(r.bin_id for r in bins.scan_bins(spark, run_folder).collect())
    assert found == ["D20240423T115846_IFCB127", "I000001", "I000001"]
    flat = bins.scan_bins(spark, run_folder, recursive=False).collect()
    assert [(r.bin_id, r.bin_type) for r in flat] == [("D20240423T115846_IFCB127", "D")]


def test_scan_points(spark, run_folder):
    columns = {"seq": "_c0", "trigger_id": "_c1", "x": "_c2", "y": "_c3", "has_roi": "cast(_c4 as int) > 0"}
    points = bins.scan_points(spark, run_folder, columns, 5)
    rows = points.filter("bin_id like 'D%'").orderBy("seq").collect()
    assert [(r.seq, r.trigger_id, r.x, r.y, r.has_roi) for r in rows] == [(0, 0, 0.0, 0.0, False), (1, 0, 0.5, 0.25, True), (2, 1, 1.0, 0.5, True)]
    assert points.count() == 6


def test_id_lists(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("I1\n\n  D2 \nI3")
    ids = bins.read_id_list(spark, str(tmp_path / "ids.txt"))
    assert [r.bin_id for r in ids.collect()] == ["I1", "D2", "I3"]
    assert bins.write_id_list(ids, "I", str(tmp_path / "out")) == 2
    assert bins.write_id_list(ids, "X", str(tmp_path / "none")) == 0 and not (tmp_path / "none").exists()


def test_training_ids(spark):
    df = spark.createDataFrame([("I1",), ("D2",), ("i3",)], "bin_id string")
    assert [r.bin_id for r in select.training_ids(df, None, "I").collect()] == ["I1"]
    listed = df.filter("bin_id = 'D2'")
    assert [r.bin_id for r in select.training_ids(df, listed, "I").collect()] == ["D2"]
    with pytest.raises(ValueError):
        select.training_ids(df, None, "X")


def test_select_units_keeps_all_without_a_list(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "bin_id string, v int")
    assert select.select_units(df, None).count() == select.select_units(df, []).count() == 3
    assert select.select_units(df, df.limit(0)).count() == 3
    assert select.select_units(df, ["a", "a", "z"]).count() == 2


def test_parse_pid(spark):
    df = spark.createDataFrame([("D20240423T115846_IFCB127",), ("I000001",), ("D20241399T115846_IFCB127",), (None,)], "bin_id string")
    rows = select.parse_pid(df).collect()
    assert str(rows[0].acquired_at) == "2024-04-23 11:58:46" and rows[0].instrument == "IFCB127" and str(rows[0].day) == "2024-04-23"
    assert all(r.acquired_at is None and r.instrument is None and r.day is None for r in rows[1:])


def test_read_score_csvs(spark, tmp_path):
    (tmp_path / "a.csv").write_text("bin_id,score\nI1,1\nI2,2\n")
    (tmp_path / "b.v2.csv").write_text("bin_id,score,note\nD1,0.5,x\n")
    (tmp_path / "empty.csv").write_text("")
    paths = [str(tmp_path / n) for n in ("a.csv", "gone.csv", "empty.csv", "b.v2.csv")]
    rows = {r.bin_id: r for r in scores.read_score_csvs(spark, paths, add_source=True).collect()}
    assert rows["I1"].score == 1.0 and rows["I1"].note is None and rows["D1"].note == "x"
    assert rows["I2"].source_file == "a" and rows["D1"].source_file == "b.v2"
    assert scores.read_score_csvs(spark, [str(tmp_path / "gone.csv")]) is None


def test_many_score_csvs_are_read_by_header(spark, tmp_path):
    paths = []
    for i in range(60):
        kind = i % 3
        header, value = ("bin_id,score", i) if kind == 0 else ("bin_id,score", i + 0.5) if kind == 1 else ("score,bin_id,note", i)
        path = tmp_path / f"run {i}+x.v1.csv"
        path.write_text(f"{header}\n{value},I{i},n\n" if kind == 2 else f"{header}\nI{i},{value}\n")
        paths.append(str(path))
    (tmp_path / "crlf.csv").write_bytes(b"bin_id,score\r\nI99,7\r\n")
    (tmp_path / "folder.csv").mkdir()
    listed = [*paths, paths[0], str(tmp_path / "crlf.csv"), str(tmp_path / "folder.csv"), "nowhere://x/y.csv"]
    tracker = spark.sparkContext.statusTracker()
    before = max(tracker.getJobIdsForGroup() or [0])
    df = scores.read_score_csvs(spark, listed, add_source=True)
    assert max(tracker.getJobIdsForGroup() or [0]) - before <= 12  # a few for each of three headers
    rows = df.collect()
    assert len(rows) == 62 and dict(df.dtypes)["score"] == "double"
    assert sum(r.source_file == "run 0+x.v1" for r in rows) == 2 and {r.source_file for r in rows if r.bin_id == "I99"} == {"crlf"}
    assert {r.bin_id: r.score for r in rows if r.bin_id in ("I1", "I3", "I5")} == {"I1": 1.5, "I3": 3.0, "I5": 5.0}
    assert sum(r.note == "n" for r in rows) == 20
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 3
    assert scores.read_score_csvs(spark, []) is None
    # A folder that Spark wrote is one table under its own name.
    spark.range(5).selectExpr("concat('I', id) as bin_id", "id as score").repartition(3).write.option("header", True).csv(str(tmp_path / "set.v2"))
    both = scores.read_score_csvs(spark, [str(tmp_path / "set.v2"), paths[0]], add_source=True).collect()
    assert sorted(r.source_file for r in both) == ["run 0+x.v1"] + ["set"] * 5


def test_manifest(spark, tmp_path):
    path = str(tmp_path / "manifest")
    assert manifest.read_manifest(spark, path).count() == 0
    status = spark.createDataFrame([("/a", True), ("/b", False), ("  ", True)], "path string, ok boolean")
    manifest.append_manifest(status, path, "r1")
    manifest.append_manifest(status, path, "r2")
    assert [r.path for r in manifest.read_manifest(spark, path).collect()] == ["/a"]


def test_summary_json(spark, tmp_path):
    (tmp_path / "s.json").write_text('{\n "total_features": 3,\n "mean_r2": 0.5\n}')
    row = tables.read_summary_json(spark, str(tmp_path / "s.json")).first()
    assert row.total_features == 3 and row.mean_r2 == 0.5 and row.num_rows_analyzed is None


def test_archive_bins(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = []
    for bin_id in ("I1", "D2"):
        for ending in ("adc", "hdr", "roi"):
            path = tmp_path / "in" / f"{bin_id}.{ending}"
            path.write_text(f"{bin_id} {ending}" * 50)
            rows.append((bin_id, f"{bin_id}.{ending}", str(path)))
    rows.append(("X3", "X3.adc", str(tmp_path / "in" / "gone")))
    df = spark.createDataFrame(rows, "bin_id string, member string, path string")
    status = {r.bin_id: r for r in media.archive_bins(df, str(tmp_path / "out"), "p/").collect()}
    assert status["I1"].ok and status["I1"].members == 3 and status["I1"].object_key == "p/I1.zip" and status["I1"].bytes == 50 * 18
    assert not status["X3"].ok and "gone" in status["X3"].error
    with zipfile.ZipFile(tmp_path / "out" / "p" / "I1.zip") as z:
        assert z.namelist() == ["I1.adc", "I1.hdr", "I1.roi"] and z.read("I1.hdr") == b"I1 hdr" * 50
    assert sorted(p.name for p in (tmp_path / "out" / "p").iterdir()) == ["D2.zip", "I1.zip"]


def test_media_validation_order(spark, tmp_path):
    (tmp_path / "ok.jpg").write_bytes(bytes.fromhex("FFD8FFE000"))
    (tmp_path / "bad.JPG").write_bytes(b"text here")
    (tmp_path / "none.avi").write_bytes(b"")
    (tmp_path / "clip.avi").write_bytes(bytes.fromhex("524946460000000041564920"))
    (tmp_path / "film.mp4").write_bytes(b"anything")
    files = media.read_heads(list_files(spark, str(tmp_path)))
    got = {r.path.split("/")[-1]: (r.valid, r.reason) for r in media.validate_media(files).collect()}
    assert got == {
        "ok.jpg": (True, None),
        "bad.JPG": (False, "cannot read image"),
        "none.avi": (False, "empty file (0 bytes)"),
        "clip.avi": (True, None),
        "film.mp4": (True, None),
    }
    counted = files.withColumn("frame_count", F.when(F.col("path").endswith("clip.avi"), 0).otherwise(9))
    got = {r.path.split("/")[-1]: r for r in media.validate_media(counted).collect()}
    assert got["clip.avi"].reason == "no frames detected" and got["film.mp4"].frame_count == 9 and got["ok.jpg"].frame_count is None
    assert all(r.valid for r in media.validate_media(counted, skip_validation=True).collect())


def test_text_functions(spark):
    df = spark.createDataFrame([("1, 2,,3",), ("None",), ("",), (None,), ("NONE",)], "t string")
    assert [r[0] for r in df.select(text.parse_int_list(F.col("t"))).collect()] == [[1, 2, 3], None, None, None, None]
    flags = spark.createDataFrame([("True",), ("False",), ("true",), (None,)], "t string")
    assert [r[0] for r in flags.select(text.try_parse_bool(F.col("t"))).collect()] == [True, False, None, None]
    with pytest.raises(Exception, match="expected True or False"):
        flags.select(text.parse_bool(F.col("t"))).collect()
    paths = spark.createDataFrame([("/d/a.b.csv",), ("/d/.hidden",), ("plain",), ("/d/e/x.TIF",)], "p string")
    p = F.col("p")
    rows = paths.select(text.base_name(p), text.suffix(p), text.media_kind(p), text.relative_path(p, "/d")).collect()
    assert [tuple(r) for r in rows] == [
        ("a.b", ".csv", "video", "a.b.csv"),
        (".hidden", "", "video", ".hidden"),
        ("plain", "", "video", "plain"),
        ("x", ".TIF", "image", "e/x.TIF"),
    ]


def test_catalog_scans(spark, tmp_path):
    for split, stem, lines in (("train", "a", "0 1 1 1 1\n2 0 0 1 1\n"), ("val", "b", "1 0 0 1 1\n"), ("train", "c", None)):
        (tmp_path / "images" / split).mkdir(parents=True, exist_ok=True)
        (tmp_path / "labels" / split).mkdir(parents=True, exist_ok=True)
        (tmp_path / "images" / split / f"{stem}.png").write_bytes(b"x")
        if lines:
            (tmp_path / "labels" / split / f"{stem}.txt").write_text(lines)
    (tmp_path / "dataset.yaml").write_text("path: /data\ntrain: images/train\n\nnames:\n  0: person\n  1: bicycle\n")
    names = catalog.read_class_names(spark, str(tmp_path / "dataset.yaml"))
    rows = catalog.dataset_catalog(catalog.scan_images(spark, str(tmp_path)), catalog.scan_labels(spark, str(tmp_path)), names).collect()
    assert {tuple(r) for r in rows} == {
        ("train", "images", "all", 2), ("val", "images", "all", 1), ("train", "images without label", "all", 1),
        ("train", "objects", "person", 1), ("train", "objects", "2", 1), ("val", "objects", "bicycle", 1),
    }


def test_provenance_appends_nodes_once(spark, tmp_path):
    runs = spark.createDataFrame([(1, "a-0", "a"), (2, "a-0", "a")], "flow_run_id long, task_key string, name string").withColumn("started", F.current_timestamp())
    provenance.append_provenance(runs, str(tmp_path))
    provenance.append_provenance(runs, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/prov_node").count() == 3
    edges = spark.read.parquet(f"{tmp_path}/prov_edge")
    assert edges.count() == 4 and edges.select("run_id").distinct().count() == 2


def test_write_embeddings(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    vectors.write_embeddings(df, str(tmp_path / "e"))
    assert dict(spark.read.parquet(str(tmp_path / "e")).dtypes)["embedding"] == "array<float>"


def test_missing_and_merge_types(spark):
    listed = spark.createDataFrame([("a",), ("b",), ("b",)], "path string")
    assert [r.path for r in select.missing_inputs(listed, listed.filter("path = 'a'")).collect()] == ["b"]
    one, two = spark.createDataFrame([(1,)], "v int"), spark.createDataFrame([("x",)], "v string")
    assert dict(scores.merge_scores([one, two]).dtypes) == {"v": "string"}


def test_write_named_files(spark, tmp_path):
    rows = spark.range(30).select((F.col("id") % 2).alias("v"), "id", F.format_string("a,%d", "id").alias("t"))
    path = F.when(F.col("v") == 0, f"{tmp_path}/m/x.csv").otherwise(f"{tmp_path}/m/y.emb.parquet")
    status = {r.out_path.split("/")[-1]: r for r in write_named(rows.withColumn("out_path", path), str(tmp_path), ("id",)).collect()}
    assert status["x.csv"].ok and status["x.csv"].rows == 15 and status["y.emb.parquet"].rows == 15
    lines = (tmp_path / "m" / "x.csv").read_text().splitlines()
    assert lines[0].replace('"', "") == "v,id,t" and lines[1] == '0,0,"a,0"' and len(lines) == 16
    assert spark.read.parquet(f"{tmp_path}/m/y.emb.parquet").count() == 15
    (tmp_path / "file").write_text("x")
    bad = write_named(rows.withColumn("out_path", F.lit(f"{tmp_path}/file/z.csv")), str(tmp_path)).collect()
    assert len(bad) == 1 and not bad[0].ok and bad[0].error


def test_day_layout(spark, tmp_path):
    df = spark.createDataFrame([("D20240423T115846_IFCB127", 1), ("D20240423T115846_IFCB127", 2)], "bin_id string, v int")
    assert bins.write_day_layout(df, df, str(tmp_path)).filter("ok").count() == 2
    folder = tmp_path / "features" / "2024-04-23"
    assert (folder / "D20240423T115846_IFCB127_features_v4.csv").exists()
    assert (folder / "multiblob" / "D20240423T115846_IFCB127_multiblob_v4.csv").exists()


def test_named_files_of_other_schemes_are_errors(spark, tmp_path):
    from binflow.sources.media import archive_bins
    from binflow.sources.named import write_named

    paths = ["s3a://bucket/x/a.csv", None, f"file:{tmp_path}/b.csv"]
    status = write_named(spark.createDataFrame([(p, 1) for p in paths], "out_path string, v int"), str(tmp_path)).collect()
    assert {r.out_path: r.ok for r in status} == {paths[0]: False, None: False, paths[2]: True}
    assert (tmp_path / "b.csv").exists()
    with pytest.raises(Exception, match="no file system for nowhere://"):
        archive_bins(spark.createDataFrame([("b", "m", b"x")], "bin_id string, member string, content binary"), "nowhere://bucket")


def test_undated_bins_have_a_folder(spark, tmp_path):
    from binflow.sources.bins import write_day_layout

    rows = spark.createDataFrame([("I1", 1.0), ("D20200102T030405_IFCB010", 2.0)], "bin_id string, v double")
    status = write_day_layout(rows, rows, str(tmp_path)).collect()
    assert len(status) == 4 and all(r.ok for r in status)
    assert (tmp_path / "features/undated/I1_features_v4.csv").exists()


def test_batches_use_all_partitions(spark):
    from binflow.operators.runs import run_batches

    plan = spark.range(200).select(F.lit(0).alias("chunk"), F.col("id").alias("batch"), F.concat(F.lit("p"), "id").alias("path"))
    assert run_batches(plan, lambda paths: None).select(F.spark_partition_id().alias("p")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
