"""Stores that are no mounts: listing, heads, split reads, sinks that write once, ledgers without shuffles."""

import os
import sys
import zipfile

import pyarrow.fs as fs
import pytest
from pyspark.sql import functions as F

from pyspark import cloudpickle

from binflow.operators import detect
from binflow.sources import bins, media
from binflow.sources.bins import _lines_of, read_lines, scan_bins, scan_points, write_day_layout
from binflow.sources.manifest import DELTAS, Ledger, append_manifest, pending_paths, read_manifest
from binflow.sources.named import write_named, write_zips
from binflow.sources.store import Files, list_files


# The store below is known to this module only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Shelf:
    """Opener of a store of its own scheme; ``broken`` names files that fail when they are opened or made."""

    def __init__(self, base, broken=None):
        self.base, self.broken = str(base), broken

    def __call__(self, root):
        if root != "shelf://box/":
            raise ValueError(f"no file system for {root}")
        return fs.PyFileSystem(Handler(self.broken)), self.base


class Handler(fs.FSSpecHandler):
    """A local folder behind a foreign interface, so that nothing can take it for a mount."""

    def __init__(self, broken):
        self.local, self.broken = fs.LocalFileSystem(), broken

    def __eq__(self, other):
        return self is other

    def get_type_name(self):
        return "shelf"

    def normalize_path(self, path):
        return path

    def get_file_info(self, paths):
        return self.local.get_file_info(paths)

    def get_file_info_selector(self, selector):
        return self.local.get_file_info(selector)

    def create_dir(self, path, recursive):
        self.local.create_dir(path, recursive=recursive)

    def delete_dir(self, path):
        self.local.delete_dir(path)

    def move(self, src, dest):
        self.local.move(src, dest)

    def _check(self, path):
        if self.broken and self.broken in path:
            raise OSError(f"broken: {path}")

    def open_input_stream(self, path):
        self._check(path)
        return self.local.open_input_stream(path)

    def open_input_file(self, path):
        self._check(path)
        return self.local.open_input_file(path)

    def open_output_stream(self, path, metadata):
        self._check(path)
        return self.local.open_output_stream(path)


@pytest.fixture
def box(tmp_path):
    (tmp_path / "box").mkdir()
    return tmp_path / "box"


def tree(box):
    return sorted(os.path.relpath(os.path.join(d, f), box) for d, _, names in os.walk(box) for f in names)


def put(box, name, data=b""):
    path = box / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def test_listing(spark, box):
    put(box, "D1.adc", b"x")
    for day in range(40):
        put(box, f"y/{day}/I{day}.adc", b"" if day % 2 else b"abc")
        put(box, f"y/{day}/deep/er/I{day}.adc", b"abcd")
        put(box, f"y/{day}/I{day}.hdr", b"zz")
    files = Files(Shelf(box))
    for root, store in (("shelf://box", files), (str(box), None), (f"file:{box}/", None)):
        shown = Files.plain(root)
        rows = {r.path: r.size for r in list_files(spark, root, "*.adc", files=store).collect()}
        assert len(rows) == 81 and rows[f"{shown}/y/1/I1.adc"] == 0 and rows[f"{shown}/y/2/deep/er/I2.adc"] == 4
        assert [r.bin_id for r in scan_bins(spark, root, recursive=False, files=store).collect()] == ["D1"]
        assert scan_bins(spark, root, files=store).groupBy("bin_type").count().where("bin_type = 'I'").first()["count"] == 80
    (box / "empty").mkdir()
    assert list_files(spark, "shelf://box/empty", files=files).count() == 0


def test_missing_folders_and_stores_raise(spark, box):
    for root, store in (("shelf://box/none", Files(Shelf(box))), (f"{box}/none", None), ("nowhere://box/x", None), ("shelf://other", Files(Shelf(box)))):
        with pytest.raises(Exception, match="FileNotFoundError|no file system"):
            list_files(spark, root, files=store).collect()


def test_heads_in_a_store(spark, box):
    put(box, "ok.jpg", bytes.fromhex("FFD8FFE000") + b"x" * 100)
    put(box, "bad.jpg", b"text")
    put(box, "lost.jpg", bytes.fromhex("FFD8FFE000"))
    put(box, "none.jpg")
    files = Files(Shelf(box, broken="lost"))
    listed = media.scan_media(spark, "shelf://box", ".jpg", files=files, heads=True)
    later = media.read_heads(media.scan_media(spark, "shelf://box", ".jpg", files=files), files)
    first = media.scan_media(spark, "shelf://box", ".jpg", 2, files=files, heads=True)
    want = {"ok": None, "bad": "cannot read image", "lost": "cannot read image", "none": "empty file (0 bytes)"}
    for found, n in ((listed, 4), (later, 4), (first, 2)):
        got = {r.path.split("/")[-1][:-4]: r.reason for r in media.validate_media(found).collect()}
        assert len(got) == n and got == {k: want[k] for k in got}
    assert all(len(r.head) <= 16 for r in listed.where("head is not null").collect())
    with pytest.raises(Exception, match="no file system"):
        media.read_heads(spark.createDataFrame([("nowhere://a/b.jpg", 1)], "path string, size long")).collect()


@pytest.mark.parametrize("data", [b"", b"\n", b"a", b"a\n", b"a\r\nbb\n\nccc", b"\n\n\nx\n", b"long line of words\n" * 7 + b"end", "é\nß€\n".encode() * 5])
def test_ranges_hold_each_line_once(monkeypatch, tmp_path, data):
    (tmp_path / "f").write_bytes(data)
    want = [x.removesuffix("\r") for x in data.decode().split("\n") if x.removesuffix("\r")]
    for size in (1, 2, 3, 5, 19, 1000):
        for block in (1, 4, 1000):
            monkeypatch.setattr(bins, "BLOCK_BYTES", block)
            got = []
            for begin in range(0, len(data), size):
                with Files().open(str(tmp_path / "f")) as stream:
                    got += [x for kept in _lines_of(stream, begin, begin + size) for x in kept]
            assert got == want


COLUMNS = {"seq": "_c0", "trigger_id": "_c1", "x": "_c2", "y": "_c3", "has_roi": "cast(_c4 as int) > 0"}


def test_points_of_listed_bins_only(spark, box):
    for i in range(6):
        put(box, f"run/D2024010{i + 1}T000000_IFCB001.adc", "".join(f"{k},{k // 2},{k * 0.5},1.5,{k % 2}\n" for k in range(50)).encode())
    put(box, "run/I000009.adc", b"1,2\n\n3,4,5,6,1,more\n")
    put(box, "run/I000010.adc")
    whole = scan_points(spark, "shelf://box", COLUMNS, 5, files=Files(Shelf(box)), split_bytes=64)
    assert whole.count() == 302 and whole.where("bin_id like 'D%'").agg(F.sum("x")).first()[0] == 6 * 0.5 * 49 * 25
    odd = sorted(tuple(r) for r in whole.where("bin_id = 'I000009'").collect())
    assert odd == [("I000009", 1, 2, None, None, None), ("I000009", 3, 4, 5.0, 6.0, True)]
    # Files of other bins cannot even be opened.
    only = Files(Shelf(box, broken="D20240101"))
    with pytest.raises(Exception, match="broken"):
        scan_points(spark, "shelf://box", COLUMNS, 5, files=only).count()
    ids = ["D20240103T000000_IFCB001", "D20240103T000000_IFCB001", "I000009", "absent"]
    assert scan_points(spark, "shelf://box", COLUMNS, 5, ids=ids, files=only).count() == 52
    assert scan_points(spark, "shelf://box", COLUMNS, 5, days=["2024-01-02", "2024-01-04"], files=only).count() == 100
    assert scan_points(spark, "shelf://box", COLUMNS, 5, days=[], files=only).count() == 0


def test_a_long_file_is_shared_out(spark, box):
    put(box, "big.adc", b"0123456789\n" * 5000)
    lines = read_lines(list_files(spark, str(box)), split_bytes=1000)
    assert lines.count() == 5000
    assert lines.select(F.spark_partition_id().alias("p")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_sink_writes_once_in_a_store(spark, box):
    files = Files(Shelf(box))
    rows = spark.range(300).select((F.col("id") % 7).alias("v"), "id", F.concat(F.lit("shelf://box/out/"), F.col("id") % 7, F.lit(".csv")).alias("out_path"))
    status = write_named(rows, "shelf://box/out", ("id",), files=files)
    assert tree(box) == [f"out/{i}.csv" for i in range(7)]  # before the status is read
    stamps = {p: (box / p).stat().st_mtime_ns for p in tree(box)}
    for _ in range(2):
        assert {(r.out_path, r.ok, r.rows) for r in status.collect()} == {(f"shelf://box/out/{i}.csv", True, 43 - (i > 5)) for i in range(7)}
    assert {p: (box / p).stat().st_mtime_ns for p in tree(box)} == stamps
    ids = [int(line.split(",")[1]) for line in (box / "out/3.csv").read_text().splitlines()[1:]]
    assert ids == list(range(3, 300, 7))


def test_failed_runs_leave_nothing_and_touch_nothing(spark, box):
    files = Files(Shelf(box))
    put(box, "out/1.txt", b"from before\n")
    rows = spark.range(100).select(F.col("id").cast("string").alias("line"), F.concat(F.lit("shelf://box/out/"), F.col("id") % 5, F.lit(".txt")).alias("out_path"))
    failing = rows.withColumn("line", F.when(F.col("line") == "83", F.raise_error(F.lit("stop here"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="stop here"):
        write_named(failing, "shelf://box/out", files=files)
    assert tree(box) == ["out/1.txt"] and (box / "out/1.txt").read_text() == "from before\n"
    assert [p.name for p in (box / "out").iterdir()] == ["1.txt"]
    assert write_named(rows, "shelf://box/out", files=files).where("ok").count() == 5
    assert len((box / "out/1.txt").read_text().splitlines()) == 20


def test_one_bad_file_does_not_stop_the_others(spark, box):
    files = Files(Shelf(box))
    paths = ["shelf://box/out/a.txt", None, "shelf://box/elsewhere.txt", "shelf://box/out/../b.txt", "shelf://other/c.txt"]
    status = write_named(spark.createDataFrame([(p, "x") for p in paths], "out_path string, line string"), "shelf://box/out", files=files)
    assert {r.out_path: r.ok for r in status.collect()} == {p: p == paths[0] for p in paths}
    assert tree(box) == ["out/a.txt"]
    nothing = spark.createDataFrame([], "out_path string, line string")
    assert write_named(nothing, "shelf://box/out", files=files).count() == 0


def test_archives_in_a_store(spark, box):
    files = Files(Shelf(box, broken="secret"))
    for bin_id in ("I1", "D2"):
        for ending in ("adc", "hdr", "roi"):
            put(box, f"in/{bin_id}.{ending}", f"{bin_id} {ending}".encode() * 50_000)
    put(box, "in/secret.adc", b"x")
    rows = [(b, f"{b}.{e}", f"shelf://box/in/{b}.{e}") for b in ("I1", "D2") for e in ("roi", "adc", "hdr")]
    rows += [("X3", "X3.adc", "shelf://box/in/gone"), ("X4", "a", "shelf://box/in/I1.adc"), ("X4", "b", "shelf://box/in/secret.adc"), (None, "c", "shelf://box/in/I1.adc")]
    df = spark.createDataFrame(rows, "bin_id string, member string, path string")
    got = {r.bin_id: r for r in media.archive_bins(df, "shelf://box/zips/", "p/", files=files).collect()}
    assert {k: r.ok for k, r in got.items()} == {"I1": True, "D2": True, "X3": False, "X4": False, None: False}
    assert got["I1"].object_key == "p/I1.zip" and got["I1"].members == 3 and got["I1"].bytes == 3 * 6 * 50_000
    assert "gone" in got["X3"].error and "broken" in got["X4"].error
    assert [p for p in tree(box) if p.startswith("zips")] == ["zips/p/D2.zip", "zips/p/I1.zip"]
    with zipfile.ZipFile(box / "zips/p/I1.zip") as z:
        assert z.testzip() is None and z.namelist() == ["I1.adc", "I1.hdr", "I1.roi"] and z.read("I1.hdr") == b"I1 hdr" * 50_000


def test_day_layout_with_masks(spark, box):
    files = Files(Shelf(box))
    pid = "D20240423T115846_IFCB127"
    table = spark.createDataFrame([(pid, 2), (pid, 1), ("I5", 3)], "bin_id string, roi int")
    masks = spark.createDataFrame([(pid, "00002.png", b"b"), (pid, "00001.png", b"aa")], "bin_id string, member string, content binary")
    status = write_day_layout(table, table, "shelf://box", masks, ("roi",), files)
    assert status.where("ok").count() == 5
    assert tree(box) == [
        f"blobs/2024-04-23/{pid}_blobs_v4.zip",
        f"features/2024-04-23/{pid}_features_v4.csv",
        f"features/2024-04-23/multiblob/{pid}_multiblob_v4.csv",
        "features/undated/I5_features_v4.csv",
        "features/undated/multiblob/I5_multiblob_v4.csv",
    ]
    assert (box / f"features/2024-04-23/{pid}_features_v4.csv").read_text().replace('"', "").splitlines() == ["bin_id,roi", f"{pid},1", f"{pid},2"]
    with zipfile.ZipFile(box / f"blobs/2024-04-23/{pid}_blobs_v4.zip") as z:
        assert z.namelist() == ["00001.png", "00002.png"] and z.read("00001.png") == b"aa"


def test_label_files_in_order(spark, box):
    rows = [("a", i, i % 3, 0.5, 1.0 * i, 0.0, 1.0 * i + 2, 4.0) for i in range(20)]
    df = spark.createDataFrame(rows, "image_id string, det_id long, class_id int, conf double, x1 double, y1 double, x2 double, y2 double")
    detect.write_detections(df.repartition(4), "shelf://box/labels", 100.0, 100.0, files=Files(Shelf(box)))
    lines = (box / "labels/a.txt").read_text().splitlines()
    assert [int(line.split()[0]) for line in lines] == [i % 3 for i in range(20)] and lines[3].split()[1] == "0.040000"


def test_zip_content_kinds(spark, box):
    df = spark.createDataFrame([(f"{box}/z.zip", "a", "text é"), (f"{box}/z.zip", "b", None)], "out_path string, member string, content string")
    row = write_zips(df, str(box)).first()
    assert row.ok and row.rows == 2 and row.bytes == 7
    with zipfile.ZipFile(box / "z.zip") as z:
        assert z.read("a").decode() == "text é" and z.read("b") == b""


# Ledgers


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_ledger_states(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"), buckets=3)
    frame = lambda rows: spark.createDataFrame(rows, "path string, ok boolean")
    files = spark.createDataFrame([("/a",), ("/b",), ("/c",), ("/a",), (None,)], "path string")
    assert ledger.pending(files).count() == 5 and ledger.latest().count() == 0
    ledger.append(frame([("/a", True), ("/b", False), ("  ", True), (None, True)]), "one")
    ledger.append(frame([("/b", True), ("/d", False)]), "two")
    want = {("/a", True, "one"), ("/b", True, "two"), ("/d", False, "two")}
    for again in (ledger, Ledger(spark, str(tmp_path / "l"))):
        assert again.buckets == 3
        assert {(r.path, r.ok, r.run_id) for r in again.latest().collect()} == want
        assert sorted((r.path for r in again.pending(files).collect()), key=str) == ["/c", None]
        assert [r.path for r in again.failed().collect()] == ["/d"]
    for _ in range(2):
        ledger.compact()
        assert ledger.table().count() == 3 and {(r.path, r.ok, r.run_id) for r in ledger.latest().collect()} == want
    ledger.append(frame([("/a", False)]), "three")
    assert {(r.path, r.ok) for r in Ledger(spark, str(tmp_path / "l")).latest().collect()} == {("/a", False), ("/b", True), ("/d", False)}
    assert len([p for p in (tmp_path / "l").iterdir()]) == 2  # the one in use and the one before


def test_ledger_is_not_shuffled(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"), buckets=4)
    for k in range(3):
        ledger.append(spark.range(k * 50, k * 50 + 100).select(F.concat(F.lit("/f"), "id").alias("path"), (F.col("id") % 2 == 0).alias("ok")), f"r{k}")
    files = spark.range(300).select(F.concat(F.lit("/f"), "id").alias("path"))
    assert exchanges(ledger.latest()) == 0
    todo = ledger.pending(files)
    plan = todo._jdf.queryExecution().executedPlan().toString()
    assert exchanges(todo) == 1 and "BroadcastExchange" not in plan and "Bucketed: true" in plan
    assert todo.count() == 300 - 100


def test_ledger_compacts_by_itself(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"), buckets=1)
    row = spark.createDataFrame([("/a", True)], "path string, ok boolean").coalesce(1)
    for k in range(DELTAS + 1):
        ledger.append(row, f"r{k}")
    assert ledger.number == 2 and ledger.table().count() == 2 and ledger.latest().first().run_id == f"r{DELTAS}"


def test_manifest_on_the_ledger(spark, tmp_path):
    path = str(tmp_path / "m")
    status = spark.createDataFrame([("/a", True, None), ("/b", False, "no")], "path string, ok boolean, error string")
    for run in ("r1", "r2"):
        append_manifest(status, path, run, buckets=2)
    assert [r.path for r in read_manifest(spark, path).collect()] == ["/a"]
    assert [r.path for r in pending_paths(status.select("path"), path).collect()] == ["/b"]
