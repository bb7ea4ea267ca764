"""Completion records over very many paths: bucketed snapshots with deltas, and the manifest of finished paths."""

from __future__ import annotations

import hashlib
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a new ledger. A ledger of 10^9 paths holds some 15 million in each of 64.
BUCKETS = 64
#: Appends after which the next one compacts the ledger.
DELTAS = 20
SCHEMA = "path string, ok boolean, error string, run_id string, done_at timestamp, seq bigint"


class Ledger:
    """Attempts by path: (path, ok, error, run_id, done_at, seq), the highest ``seq`` of a path being its state.

    Rows lie in Parquet buckets by the hash of the path. An append adds a delta to the buckets it touches and reads none of them;
    :meth:`compact` rewrites one row per path. Joins and groups by path use the buckets as they are: the history is
    never shuffled. One writer at a time.

    ``folder`` holds generations ``g<number>-b<buckets>``; the highest complete one counts.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder = spark, folder.rstrip("/")
        found = self._generations()
        self.number, self.buckets = found[-1] if found else (0, buckets)
        self.exists = bool(found)

    def _system(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _generations(self) -> list[tuple[int, int]]:
        """(number, buckets) of the complete generations; a handful of folders whatever the ledger holds."""
        system, path = self._system()
        if not system.exists(path):
            return []
        found = []
        for status in system.listStatus(path):
            name = status.getPath().getName()
            mark = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
            if name.startswith("g") and "-b" in name and system.exists(mark):
                number, buckets = name[1:].split("-b")
                found.append((int(number), int(buckets)))
        return sorted(found)

    def _place(self, number: int) -> tuple[str, str]:
        """Table name and folder of a generation."""
        digest = hashlib.md5(f"{self.folder}/{number}".encode()).hexdigest()
        return f"binflow_ledger_{digest}", f"{self.folder}/g{number:06d}-b{self.buckets}"

    def table(self) -> DataFrame:
        """All rows as they lie in the buckets."""
        if not self.exists:
            return self.spark.createDataFrame([], SCHEMA)
        name, place = self._place(self.number)
        # A session knows its own tables only; the files are the ledger. They may have changed since.
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({SCHEMA}) USING parquet "
            f"CLUSTERED BY (path) SORTED BY (path) INTO {self.buckets} BUCKETS LOCATION '{place}'"
        )
        self.spark.catalog.refreshTable(name)
        return self.spark.table(name)

    def latest(self) -> DataFrame:
        """One row per path, its last attempt. Grouped inside the buckets."""
        rest = [c for c in ("ok", "error", "run_id", "done_at", "seq")]
        last = F.max_by(F.struct(*rest), "seq").alias("_last")
        return self.table().groupBy("path").agg(last).select("path", "_last.*")

    def done(self) -> DataFrame:
        """The paths that are finished, each once."""
        return self.latest().where("ok").select("path")

    def failed(self) -> DataFrame:
        return self.latest().where(~F.col("ok"))

    def pending(self, files: DataFrame) -> DataFrame:
        """``files`` whose exact path is not finished. Only ``files`` is shuffled, to the ledger's buckets.

        The merge hint keeps Spark from gathering the finished paths for a broadcast.
        """
        if not self.exists:
            return files
        return files.join(self.done().hint("merge"), "path", "left_anti")

    def append(self, status: DataFrame, run_id: str) -> None:
        """Add attempts (path, ok, error). Blank paths are dropped. Call it after the outputs are committed."""
        if self.exists and self._deltas() >= DELTAS:
            self.compact()
        error = F.col("error") if "error" in status.columns else F.lit(None)
        rows = status.where(F.trim("path") != "").select(
            F.trim("path").alias("path"),
            "ok",
            error.cast("string").alias("error"),
            F.lit(run_id).alias("run_id"),
            F.current_timestamp().alias("done_at"),
            F.lit(time.time_ns()).alias("seq"),
        )
        self.number = max(self.number, 1)
        self._write(rows.repartition(self.buckets, "path"), self.number)
        self.exists = True

    def _write(self, rows: DataFrame, number: int) -> None:
        name, place = self._place(number)
        if self.exists and number == self.number:
            self.table()  # known to this session
        writer = rows.write.format("parquet").bucketBy(self.buckets, "path").sortBy("path")
        writer.mode("append").option("path", place).saveAsTable(name)

    def _deltas(self) -> int:
        """Most files of a bucket: appends since the last compaction."""
        system, _ = self._system()
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._place(self.number)[1])
        files = [s.getPath().getName() for s in system.listStatus(place) if s.getPath().getName().startswith("part-")]
        return -(-len(files) // self.buckets)

    def compact(self) -> None:
        """Rewrite one row per path as a new generation. Readers of the old one are not disturbed; it is removed by the next."""
        if not self.exists:
            return
        old = self.number
        self._write(self.latest(), old + 1)
        for number, buckets in self._generations():
            if number < old:
                name, place = self._place(number)
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
                system, _ = self._system()
                system.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place), True)
        self.number = old + 1


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Distinct finished paths; an absent manifest is an empty set."""
    return Ledger(spark, path).done()


def append_manifest(status: DataFrame, path: str, run_id: str, buckets: int = BUCKETS) -> None:
    """Append the successful paths. Call it after the outputs are committed."""
    Ledger(status.sparkSession, path, buckets).append(status.where("ok"), run_id)


def pending_paths(files: DataFrame, path: str) -> DataFrame:
    """Files whose exact path is not in the manifest at ``path``; the manifest is not shuffled."""
    return Ledger(files.sparkSession, path).pending(files)
