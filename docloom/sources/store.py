"""Document stores: an append-only log of versions, on disk as Parquet or in memory."""

from __future__ import annotations

import json
import threading
import time
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changelog

LOG = "id string, seq bigint, doc string, deleted boolean, history map<string,bigint>"
CONFLICTS = LOG
CLEARED = "id string, seq bigint"
INDEXES = "id string, at bigint, fields array<struct<name string, expression string>>, condition string, version bigint, last_seq bigint, failed boolean, deleted boolean, serving bigint, python string"
ENTRIES = "id string, seq bigint, present boolean, s map<string,array<string>>, n map<string,array<bigint>>, d map<string,array<double>>, error string"
REPLICATION = "source string, at bigint, last_seq bigint, total bigint"
TABLES = {"log": LOG, "conflicts": CONFLICTS, "cleared": CLEARED, "indexes": INDEXES, "replication": REPLICATION}


class Store:
    """A log of versions (id, seq, doc as JSON, deleted, history) and a table of conflicts.

    A commit is one write job: readers see all of its rows or none. Positions
    are given out by the process that writes; one process writes at a time.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.lock = spark, threading.RLock()

    def log(self) -> DataFrame:
        raise NotImplementedError

    def conflicts(self) -> DataFrame:
        raise NotImplementedError

    def append(self, rows: DataFrame, newest: int | None = None) -> None:
        raise NotImplementedError

    def append_conflicts(self, rows: DataFrame, newest: int | None = None) -> None:
        raise NotImplementedError

    def clear_conflicts(self, id: str) -> None:
        raise NotImplementedError

    def newest(self) -> int:
        """The last position given out, conflicts included."""
        both = self.log().select("seq").unionByName(self.conflicts().select("seq"))
        return both.agg(F.max("seq")).first()[0] or 0

    def snapshot(self) -> DataFrame:
        return changelog.snapshot(self.log())

    def versions(self) -> DataFrame:
        """The last version of each id, deleted ones included."""
        return changelog.latest(self.log(), "id", "seq")

    def versions_of(self, ids: list[str]) -> dict[str, dict]:
        """The histories of the last versions of these ids. Few ids are looked up by a filter that reaches the scan."""
        log = self.log().select("id", "seq", "history")
        some = log.filter(F.col("id").isin(ids)) if len(ids) <= 1000 else log.join(self.spark.createDataFrame([(i,) for i in ids], "id string"), "id", "left_semi")
        return {r["id"]: dict(r["history"]) for r in changelog.latest(some, "id", "seq").collect()}

    def rows(self, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, LOG)

    def staged(self, rows: DataFrame) -> DataFrame:
        """Rows that no longer depend on the log, so that it may grow while they are written."""
        raise NotImplementedError

    def append_entries(self, index: str, version: int, at: int, rows: DataFrame) -> DataFrame:
        """Write what a pass up to position ``at`` made of an index, in the place of what an earlier try left; the rows written."""
        raise NotImplementedError

    def entries(self, index: str, version: int) -> DataFrame:
        raise NotImplementedError

    def replication(self, source: str) -> dict | None:
        """Position and number of rows of the last batch from a source."""
        raise NotImplementedError

    def save_replication(self, source: str, last_seq: int, total: int) -> None:
        raise NotImplementedError

    def indexes(self) -> list[dict]:
        """The last row of each index definition that was saved; as many as there are indexes."""
        return []

    def append_index(self, row: dict) -> None:
        """Save a row of the catalog. What is in memory only has nothing to save."""


class MemoryStore(Store):
    """For tests and small working sets: rows are kept in the driver."""

    def __init__(self, spark: SparkSession):
        super().__init__(spark)
        self._entries: dict[tuple[str, int], dict[int, list[tuple]]] = {}
        self._sources: dict[str, dict] = {}
        self._log: list[tuple] = []
        self._conflicts: list[tuple] = []

    def log(self) -> DataFrame:
        return self.rows(list(self._log))

    def conflicts(self) -> DataFrame:
        return self.rows(list(self._conflicts))

    def append(self, rows: DataFrame, newest: int | None = None) -> None:
        self._log += [tuple(r) for r in rows.collect()]

    def append_conflicts(self, rows: DataFrame, newest: int | None = None) -> None:
        self._conflicts += [tuple(r) for r in rows.collect()]

    def clear_conflicts(self, id: str) -> None:
        self._conflicts = [r for r in self._conflicts if r[0] != id]

    def staged(self, rows: DataFrame) -> DataFrame:
        return self.spark.createDataFrame([tuple(r) for r in rows.collect()], rows.schema)

    def append_entries(self, index: str, version: int, at: int, rows: DataFrame) -> DataFrame:
        found = self._entries.setdefault((index, version), {})[at] = [tuple(r) for r in rows.collect()]
        return self.spark.createDataFrame(found, ENTRIES)

    def entries(self, index: str, version: int) -> DataFrame:
        return self.spark.createDataFrame([r for rows in self._entries.get((index, version), {}).values() for r in rows], ENTRIES)

    def replication(self, source: str) -> dict | None:
        return self._sources.get(source)

    def save_replication(self, source: str, last_seq: int, total: int) -> None:
        self._sources[source] = {"last_synctag": last_seq, "total": total}


class ParquetStore(Store):
    """A directory of Parquet files; each commit is one append to ``log``."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark)
        self.path = path.rstrip("/")
        self._newest: int | None = None
        for name in TABLES:
            # An empty append makes the directory and its schema.
            self._rows_of(name).write.mode("append").parquet(f"{self.path}/{name}")

    def _rows_of(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], TABLES[name])

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self._rows_of(name).schema).parquet(f"{self.path}/{name}")

    def log(self) -> DataFrame:
        return self._read("log")

    def conflicts(self) -> DataFrame:
        """Conflicts after the last time their id's were cleared; files that are being read are never rewritten."""
        cleared = self._read("cleared").groupBy("id").agg(F.max("seq").alias("until"))
        rows = self._read("conflicts").join(cleared, "id", "left")
        return rows.filter(F.col("until").isNull() | (F.col("seq") > F.col("until"))).drop("until")

    def newest(self) -> int:
        """Looked up once by the process that writes, and again after rows whose positions it didn't give out."""
        if self._newest is None:
            both = self._read("log").select("seq").unionByName(self._read("conflicts").select("seq"))
            self._newest = both.agg(F.max("seq")).first()[0] or 0
        return self._newest

    def append(self, rows: DataFrame, newest: int | None = None) -> None:
        """``newest``: the last position in ``rows`` if the caller knows it."""
        rows.write.mode("append").parquet(f"{self.path}/log")
        self._newest = newest

    def append_conflicts(self, rows: DataFrame, newest: int | None = None) -> None:
        rows.write.mode("append").parquet(f"{self.path}/conflicts")
        self._newest = newest

    def compact(self, files: int = 1) -> None:
        """Bring the log's many small commits into few files, sorted by id, so that lookups skip most of them.

        The new files are written beside the old ones and take their place by renaming; no reader may be in
        the middle of a scan. One process writes at a time, as always.
        """
        with self.lock:
            fs, old, new = self._fs(), f"{self.path}/log", f"{self.path}/log-compact"
            self.log().repartitionByRange(files, "id", "seq").sortWithinPartitions("id", "seq").write.mode("overwrite").parquet(new)
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
            fs.delete(path(f"{old}-before"), True)
            fs.rename(path(old), path(f"{old}-before"))
            fs.rename(path(new), path(old))
            fs.delete(path(f"{old}-before"), True)

    def _fs(self):
        sc = self.spark.sparkContext
        return sc._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(sc._jsc.hadoopConfiguration())

    def staged(self, rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.path}/staged")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/staged")

    def _entries(self, index: str, version: int) -> str:
        return f"{self.path}/entries/{quote(index, safe='')}-{version}"

    def append_entries(self, index: str, version: int, at: int, rows: DataFrame) -> DataFrame:
        path = f"{self._entries(index, version)}/at={at}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def entries(self, index: str, version: int) -> DataFrame:
        empty, path = self.spark.createDataFrame([], ENTRIES), self._entries(index, version)
        if not self._fs().exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)):
            return empty
        return self.spark.read.schema(empty.schema).parquet(path).select(empty.columns)

    def replication(self, source: str) -> dict | None:
        row = self._read("replication").filter(F.col("source") == source).orderBy(F.col("at").desc()).first()
        return None if row is None else {"last_synctag": row["last_seq"], "total": row["total"]}

    def save_replication(self, source: str, last_seq: int, total: int) -> None:
        self.spark.createDataFrame([(source, time.time_ns(), last_seq, total)], REPLICATION).write.mode("append").parquet(f"{self.path}/replication")

    def clear_conflicts(self, id: str) -> None:
        rows = self.spark.createDataFrame([(id, self.newest())], CLEARED)
        rows.write.mode("append").parquet(f"{self.path}/cleared")

    def indexes(self) -> list[dict]:
        return [r.asDict(recursive=True) for r in changelog.latest(self._read("indexes"), "id", "at").collect()]

    def append_index(self, row: dict) -> None:
        with self.lock:
            self.spark.createDataFrame([row], INDEXES).write.mode("append").parquet(f"{self.path}/indexes")


def encode(doc: object) -> str:
    return json.dumps(doc, ensure_ascii=False)


def decode(text: str | None) -> object:
    return None if text is None else json.loads(text)
