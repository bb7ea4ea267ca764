"""Files of any store through one interface: listing, leading bytes, reading, writing, moving."""

from __future__ import annotations

import fnmatch
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Turns the root of a store, like ``s3://bucket/``, into a file system and the path of that root in it.
Opener = Callable[[str], tuple[fs.FileSystem, str]]
#: Entries of a local folder that are looked at together.
ENTRIES = 10_000
#: Most partitions of a listing.
PARTITIONS = 512


def open_root(root: str) -> tuple[fs.FileSystem, str]:
    """Mounted folders, and the stores that pyarrow knows: s3, gs, abfs, hdfs. ValueError for any other scheme."""
    if root == "/":
        return fs.LocalFileSystem(), "/"
    try:
        return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", root))
    except pa.ArrowInvalid as problem:
        raise ValueError(f"no file system for {root}: {problem}") from problem


class Files:
    """Files by URI. A path without scheme, or with ``file:``, is on a mount that all executors share.

    Travels to tasks by its opener alone; each task opens a store once.
    """

    def __init__(self, opener: Opener = open_root):
        self.opener = opener
        self.roots: dict[str, tuple[fs.FileSystem, str]] = {}

    def __getstate__(self) -> dict:
        return {"opener": self.opener, "roots": {}}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)

    @staticmethod
    def plain(uri: str) -> str:
        """The URI without ``file:`` and without slashes at its end."""
        return re.sub(r"^file:/*", "/", uri, flags=re.IGNORECASE).rstrip("/") or "/"

    def at(self, uri: str) -> tuple[fs.FileSystem, str]:
        uri = self.plain(uri)
        remote = re.match(r"[A-Za-z][A-Za-z0-9+.-]+://[^/]*", uri)
        root = remote[0] + "/" if remote else "/"
        if root not in self.roots:
            self.roots[root] = self.opener(root)
        system, base = self.roots[root]
        rest = uri[len(root) :] if remote else os.path.abspath(uri)[1:]
        return system, f"{base.rstrip('/')}/{rest}".rstrip("/") if rest else base

    def exists(self, uri: str) -> bool:
        system, path = self.at(uri)
        return system.get_file_info(path).type != fs.FileType.NotFound

    def is_folder(self, uri: str) -> bool:
        system, path = self.at(uri)
        return system.get_file_info(path).type == fs.FileType.Directory

    def entries(self, folder: str) -> Iterator[tuple[str, bool, int]]:
        """(uri, is a folder, size) of what lies directly in a folder. A folder that is missing or cannot be read raises."""
        system, path = self.at(folder)
        base = self.plain(folder).rstrip("/")
        if isinstance(system, fs.LocalFileSystem):
            # As a stream: one folder may hold millions of files.
            with os.scandir(path) as found:
                while chunk := list(islice(found, ENTRIES)):
                    for e in chunk:
                        yield f"{base}/{e.name}", e.is_dir(), 0 if e.is_dir() else e.stat().st_size
            return
        for e in system.get_file_info(fs.FileSelector(path)):
            yield f"{base}/{e.base_name}", e.type == fs.FileType.Directory, e.size or 0

    def walk(self, folder: str, recursive: bool) -> Iterator[tuple[str, int]]:
        """(uri, size) of the files of a folder, with ``recursive`` of all below it. Empty files count."""
        todo = [folder]
        while todo:
            for uri, is_folder, size in self.entries(todo.pop()):
                if not is_folder:
                    yield uri, size
                elif recursive:
                    todo.append(uri)

    def head(self, uri: str, size: int) -> bytes | None:
        """The first bytes of a file; None where the file is not there or cannot be read."""
        system, path = self.at(uri)
        try:
            with system.open_input_stream(path, buffer_size=0) as stream:
                return stream.read(size)
        except OSError:
            return None

    def size(self, uri: str) -> int:
        system, path = self.at(uri)
        info = system.get_file_info(path)
        if info.type != fs.FileType.File:
            raise FileNotFoundError(uri)
        return info.size

    def open(self, uri: str) -> pa.NativeFile:
        """A file to read from any place."""
        system, path = self.at(uri)
        return system.open_input_file(path)

    def create(self, uri: str) -> pa.NativeFile:
        """A stream to a new file; the folders above are made where the store has such."""
        system, path = self.at(uri)
        system.create_dir(os.path.dirname(path), recursive=True)
        return system.open_output_stream(path)

    def move(self, uri: str, target: str) -> None:
        """Put a complete file in its place, over one that is there. Once moved, moving again changes nothing."""
        system, path = self.at(uri)
        _, new = self.at(target)
        if system.get_file_info(path).type == fs.FileType.NotFound and self.exists(target):
            return
        system.create_dir(os.path.dirname(new), recursive=True)
        system.move(path, new)

    def delete_folder(self, uri: str) -> None:
        system, path = self.at(uri)
        if system.get_file_info(path).type == fs.FileType.Directory:
            system.delete_dir(path)


def to_text(value: object) -> str:
    """An object as text, for options of data sources."""
    return cloudpickle.dumps(value).hex()


def from_text(value: str) -> object:
    return cloudpickle.loads(bytes.fromhex(value))


@dataclass
class Folders(InputPartition):
    """Folders that one task lists: each with the folders below it or without."""

    folders: list[tuple[str, bool]]


class FileListing(DataSource):
    """Files below a folder as rows (path, size, head); ``head`` is there only when its size is given."""

    @classmethod
    def name(cls) -> str:
        return "binflow_files"

    def schema(self) -> str:
        return "path string, size bigint, head binary" if "head" in self.options else "path string, size bigint"

    def reader(self, schema) -> DataSourceReader:
        return FileReader(self.options)


class FileReader(DataSourceReader):
    """One partition per folder, or per group of folders where there are many.

    The driver goes down folder levels only until there are enough folders to deal out; tasks walk what lies below.
    """

    def __init__(self, options):
        self.root = options["root"]
        self.pattern = options["pattern"]
        self.recursive = options["recursive"] == "true"
        self.wanted = int(options["partitions"])
        self.head = int(options["head"]) if "head" in options else None
        self.files: Files = from_text(options["files"])

    def partitions(self) -> list[InputPartition]:
        if not self.files.exists(self.root):
            raise FileNotFoundError(self.root)
        level, own = [self.root], []
        while self.recursive and level and len(level) < self.wanted:
            below = [uri for folder in level for uri, is_folder, _ in self.files.entries(folder) if is_folder]
            own += [(folder, False) for folder in level]
            level = below
        units = own + [(folder, self.recursive) for folder in level]
        # Neighbours go to different tasks.
        return [Folders(units[i :: self.wanted]) for i in range(min(self.wanted, len(units)))]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        keep = re.compile(fnmatch.translate(self.pattern)).match
        found = (
            (uri, size)
            for folder, recursive in partition.folders
            for uri, size in self.files.walk(folder, recursive)
            if keep(uri.rsplit("/", 1)[-1])
        )
        while chunk := list(islice(found, ENTRIES)):
            columns = [pa.array([uri for uri, _ in chunk], pa.string()), pa.array([size for _, size in chunk], pa.int64())]
            if self.head is not None:
                columns.append(pa.array([self.files.head(uri, self.head) for uri, _ in chunk], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["path", "size", "head"][: len(columns)])


def list_files(
    spark: SparkSession, root: str, pattern: str = "*", recursive: bool = True, head: int | None = None, files: Files | None = None
) -> DataFrame:
    """path and size of the files below ``root`` whose names fit the pattern, with ``head`` their first bytes.

    Any store that ``files`` opens; empty files are listed. Nothing else is read. A missing folder or a
    store that cannot be reached is an error.
    """
    spark.dataSource.register(FileListing)
    options = {
        "root": root,
        "pattern": pattern,
        "recursive": str(recursive).lower(),
        "partitions": str(min(PARTITIONS, 4 * spark.sparkContext.defaultParallelism)),
        "files": to_text(files or Files()),
    }
    if head is not None:
        options["head"] = str(head)
    return spark.read.format("binflow_files").options(**options).load()


def read_json(files: Files, uri: str) -> object:
    with files.open(uri) as stream:
        return json.loads(stream.read())


def write_json(files: Files, uri: str, value: object) -> None:
    with files.create(uri) as stream:
        stream.write(json.dumps(value).encode())
