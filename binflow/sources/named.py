"""One file per output path, in the layout the caller names, written once and put in place together."""

from __future__ import annotations

import io
import shutil
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import csv, parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from binflow.session import materialize
from binflow.sources.store import Files, from_text, read_json, to_text, write_json

STATUS_SCHEMA = "out_path string, ok boolean, error string, rows bigint, bytes bigint"
#: Problems of one file: they become its status, and the others go on.
PROBLEMS = (OSError, ValueError, pa.ArrowException, zipfile.BadZipFile)


class _Lines:
    """Text lines from the only column of each batch."""

    def __init__(self, stream: pa.NativeFile):
        self.stream = stream

    def write(self, batch: pa.RecordBatch) -> None:
        self.stream.write("".join(f"{line}\n" for line in batch.column(0).to_pylist()).encode())

    def close(self) -> None:
        pass


class _Table:
    """Rows of one file; the ending of its name chooses the format."""

    def __init__(self, files: Files, path: str, stream: pa.NativeFile, schema: pa.Schema):
        if path.endswith(".parquet"):
            self.writer = parquet.ParquetWriter(stream, schema)
        elif path.endswith((".txt", ".adc")):
            self.writer = _Lines(stream)
        else:
            self.writer = csv.CSVWriter(stream, schema, write_options=csv.WriteOptions(include_header=True, quoting_style="needed"))
        self.bytes = 0

    def add(self, batch: pa.RecordBatch) -> None:
        self.writer.write(batch)
        self.bytes += batch.nbytes

    def close(self) -> None:
        self.writer.close()


class _Zip:
    """Members (name, path or content) of one archive. A member is copied as a stream and never held whole."""

    def __init__(self, files: Files, path: str, stream: pa.NativeFile, schema: pa.Schema):
        self.files, self.bytes = files, 0
        self.from_path = schema.names[1] == "path"
        # The archive goes out as it comes: most stores cannot go back in a file.
        self.zip = zipfile.ZipFile(_Forward(stream), "w", zipfile.ZIP_DEFLATED)

    def add(self, batch: pa.RecordBatch) -> None:
        for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if self.from_path:
                size = self.files.size(value)
                with self.files.open(value) as source, self.zip.open(name, "w", force_zip64=True) as out:
                    shutil.copyfileobj(source, out, 1 << 20)
            else:
                data = value.encode() if isinstance(value, str) else bytes(value or b"")
                size = len(data)
                self.zip.writestr(name, data)
            self.bytes += size

    def close(self) -> None:
        self.zip.close()


class _Forward(io.RawIOBase):
    """A stream that can only be written."""

    def __init__(self, stream: pa.NativeFile):
        self.stream = stream

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.stream.write(bytes(data))
        return len(data)


KINDS = {"table": _Table, "zip": _Zip}


class _Unit:
    """One file under a spare name."""

    def __init__(self, files: Files, root: str, path: str | None, spare: str, kind: str, schema: pa.Schema):
        self.path, self.spare, self.rows, self.error = path, spare, 0, None
        self.stream = self.body = None
        try:
            if path is None:
                raise ValueError("no output path")
            if not Files.plain(path).startswith(Files.plain(root).rstrip("/") + "/") or "/../" in path:
                raise ValueError(f"not below {root}: {path}")
            self.stream = files.create(spare)
            self.body = KINDS[kind](files, path, self.stream, schema)
        except PROBLEMS as problem:
            self._fail(problem)

    def _fail(self, problem: Exception) -> None:
        self.error = self.error or str(problem) or type(problem).__name__

    def add(self, batch: pa.RecordBatch) -> None:
        if self.error is None:
            try:
                self.body.add(batch)
                self.rows += batch.num_rows
            except PROBLEMS as problem:
                self._fail(problem)

    def close(self) -> tuple:
        for part in (self.body, self.stream):
            try:
                if part is not None:
                    part.close()
            except PROBLEMS as problem:
                self._fail(problem)
        written = self.body.bytes if self.error is None else 0
        return self.path, self.error is None, self.error, self.rows, written, self.spare


PART_SCHEMA = pa.schema(
    [
        ("out_path", pa.string()), ("ok", pa.bool_()), ("error", pa.string()), ("rows", pa.int64()), ("bytes", pa.int64()),
        ("spare", pa.string()),
    ]
)


@dataclass
class Written(WriterCommitMessage):
    """What a task sends to the driver: where the status of its files is, not the status itself."""

    part: str


class NamedFiles(DataSource):
    """Sink of one file per ``out_path``. Rows come sorted by it; all files stay under spare names."""

    @classmethod
    def name(cls) -> str:
        return "binflow_named"

    def schema(self) -> str:
        return "out_path string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return NamedWriter(self.options)


class NamedWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.root, self.spare, self.kind = options["root"], options["spare"], options["kind"]
        self.files: Files = from_text(options["files"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        # A retried or doubled task has a folder of its own; what the driver commits is one attempt.
        mine = f"{self.spare}/{uuid.uuid4().hex}"
        count = 0
        with self.files.create(f"{mine}/status.parquet") as stream, parquet.ParquetWriter(stream, PART_SCHEMA) as status:

            def note(unit: _Unit) -> None:
                columns = [pa.array([v], f.type) for v, f in zip(unit.close(), PART_SCHEMA)]
                done.append(pa.RecordBatch.from_arrays(columns, schema=PART_SCHEMA))
                if len(done) >= 1000:
                    flush()

            def flush() -> None:
                if done:
                    status.write_table(pa.Table.from_batches(done))
                    done.clear()

            done: list[pa.RecordBatch] = []
            unit: _Unit | None = None
            for batch in iterator:
                paths = batch.column("out_path").to_numpy(zero_copy_only=False)
                if not len(paths):
                    continue
                body = batch.drop_columns(["out_path"])
                starts = np.flatnonzero(np.r_[True, paths[1:] != paths[:-1]])
                for start, stop in zip(starts, np.r_[starts[1:], len(paths)]):
                    if unit is None or unit.path != paths[start]:
                        if unit is not None:
                            note(unit)
                        unit = _Unit(self.files, self.root, paths[start], f"{mine}/{count}", self.kind, body.schema)
                        count += 1
                    unit.add(body.slice(start, stop - start))
            if unit is not None:
                note(unit)
            flush()
        return Written(f"{mine}/status.parquet")

    def commit(self, messages: list[Written | None]) -> None:
        write_json(self.files, f"{self.spare}/committed.json", [m.part for m in messages if m is not None])

    def abort(self, messages: list[Written | None]) -> None:
        self.files.delete_folder(self.spare)


def write_units(laid: DataFrame, root: str, kind: str, files: Files) -> DataFrame:
    """Write rows, which come together by ``out_path``, to the files of these paths; returns the status of each file.

    1. Tasks write whole files to a spare folder below ``root`` and the status of theirs beside them. Commit
       messages name these, so the driver never holds a row per file. A task or job that fails leaves no file in
       place, and none of an earlier run is touched.
    2. After the commit, tasks move the good files to their names. Moving twice changes nothing.

    Both have happened when this returns. The status is a table: reading it writes nothing.
    """
    spark = laid.sparkSession
    spark.dataSource.register(NamedFiles)
    root = Files.plain(root)
    spare = f"{root}/.spare-{uuid.uuid4().hex}"
    try:
        options = {"root": root, "spare": spare, "kind": kind, "files": to_text(files)}
        laid.write.format("binflow_named").mode("append").options(**options).save()
        parts = [(p,) for p in read_json(files, f"{spare}/committed.json")]

        def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in batch.column(0).to_pylist():
                    with files.open(part) as stream:
                        yield from (_moved(files, rows) for rows in parquet.ParquetFile(stream).iter_batches(1000))

        if not parts:
            return spark.createDataFrame([], STATUS_SCHEMA)
        todo = spark.createDataFrame(parts, "part string").repartition(len(parts))
        return materialize(todo.mapInArrow(publish, STATUS_SCHEMA))
    finally:
        files.delete_folder(spare)


def _moved(files: Files, rows: pa.RecordBatch) -> pa.RecordBatch:
    out = []
    for path, ok, error, n, size, spare in zip(*[c.to_pylist() for c in rows.columns]):
        if ok:
            try:
                files.move(spare, path)
            except PROBLEMS as problem:
                ok, error, size = False, str(problem), 0
        out.append((path, ok, error, n, size))
    columns = [pa.array(list(c), f.type) for c, f in zip(zip(*out), PART_SCHEMA)]
    return pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(PART_SCHEMA)[:5]))


def _laid(df: DataFrame, order_by: tuple[str, ...], columns: list[str]) -> DataFrame:
    # A set number of partitions: paths are few bytes, and these must not mean one task.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, "out_path").sortWithinPartitions("out_path", *order_by).select("out_path", *columns)


def write_named(
    df: DataFrame, root: str, order_by: tuple[str, ...] = (), columns: list[str] | None = None, files: Files | None = None
) -> DataFrame:
    """Write rows to the file in their ``out_path`` below ``root``; its ending chooses Parquet, plain
    text lines (``.txt`` and ``.adc``, one column) or CSV with header.

    ``columns`` are the ones written (all but ``out_path``), in the order of ``order_by``. Returns a status row per file: out_path,
    ok, error, rows, bytes. A file is one stream, so it has one writer; rows pass through it batch by batch. A path
    that is NULL, lies elsewhere or cannot be written gives a status row with its error, and the others go on. See
    :func:`write_units` for what is left behind by a failure.
    """
    columns = columns or [c for c in df.columns if c != "out_path"]
    return write_units(_laid(df, order_by, columns), root, "table", files or Files())


def write_zips(members: DataFrame, root: str, files: Files | None = None) -> DataFrame:
    """Write members to the zip in their ``out_path`` below ``root``, in order of their names.

    Input: out_path, member, and path (the file is read in the task) or content. Status as in :func:`write_named`; ``rows`` counts
    members. An archive with a member that cannot be read is not written.
    """
    source = "path" if "path" in members.columns else "content"
    laid = _laid(members, ("member",), [F.col("member"), F.col(source)])
    return write_units(laid, root, "zip", files or Files())
