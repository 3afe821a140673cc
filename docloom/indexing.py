"""Stored indexes: passes over the log, backfill of new definitions, progress, failure."""

from __future__ import annotations

import time
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import changelog, indexes
from .operators.indexes import DEFAULT, Catalog, IndexDef
from .sources.store import Store

#: Of the messages of a pass that are kept with its statistics.
ERRORS_KEPT = 100


class Indexer:
    """Keeps the entries of all indexes in the store.

    A pass takes what changed after the oldest position of the indexes that take
    part (failed ones don't), maps it once for each index, appends the entries,
    and only then moves the index's position: a pass that dies is done again and
    replaces its own rows. A document that can't be mapped keeps its old entry.
    A new or changed definition is a version of its own, filled from the
    beginning of the log while the version before it still serves queries, and
    takes its place once it has caught up.
    """

    def __init__(self, store: Store, catalog: Catalog, emit: Callable[[str, int], None], pass_rows: int | None = None):
        """``pass_rows``: the most log rows in a pass of the indexes that have caught up; no limit without it."""
        self.store, self.catalog, self.emit, self.pass_rows = store, catalog, emit, pass_rows
        self.mappers: dict[str, Callable[[object], dict | None]] = {}
        #: Of the last pass of each index: total, errors, indexed, messages.
        self.stats: dict[str, dict] = {}
        #: Pairs of a document and an index in the last pass.
        self.doc_count = 0

    def _mapped(self, changes: DataFrame, id: str) -> DataFrame:
        index = self.catalog.get(id)
        if id == DEFAULT:
            return indexes.default_entries(changes)
        if index.python is not None:
            return indexes.python_entries(changes, index, self.mappers[index.python])
        return indexes.sql_entries(changes, index)

    def _map_one(self, changes: DataFrame, id: str, at: int) -> dict:
        version = self.catalog.version(id)
        try:
            rows = self.store.append_entries(id, version, at, self._mapped(changes, id))
        except (Py4JJavaError, PySparkException) as e:  # a SQL expression failed, and with it the whole pass
            total = changes.count()
            return {"total": total, "errors": total, "indexed": 0, "messages": [str(e)[:500]]}
        found = rows.agg(F.count("*").alias("total"), F.count("error").alias("errors"), F.count_if(F.col("error").isNull() & F.col("present")).alias("indexed")).first().asDict()
        messages = rows.filter("error is not null").select("error").limit(ERRORS_KEPT).collect() if found["errors"] else []
        return found | {"messages": [r["error"] for r in messages]}

    def run_pass(self, ids: list[str], limit: int | None = None) -> int:
        """One pass of these indexes; the number of (document, index) pairs, 0 if there was nothing to do."""
        ids = [i for i in ids if not self.catalog.is_failed(i)]
        self.doc_count = 0
        if not ids:
            return 0
        start = min(self.catalog.last_seq(i) for i in ids)
        log = self.store.log().filter(F.col("seq") > start)
        if limit is not None:
            log = log.orderBy("seq").limit(limit)
        at = log.agg(F.max("seq")).first()[0]
        if at is None:
            return 0
        for id in ids:
            if self.catalog.last_seq(id) >= at:
                continue
            # An index that is further on than the oldest one takes only what it hasn't seen.
            own = log.filter(F.col("seq") > self.catalog.last_seq(id))
            changes = changelog.latest(own, "id", "seq").select("id", "seq", "deleted", F.parse_json("doc").alias("doc"), F.col("doc").alias("json"))
            stats = self.stats[id] = self._map_one(changes, id, at)
            self.catalog.advance(id, at)
            if indexes.is_failing(stats["total"], stats["errors"]):
                self.catalog.mark_failed(id)
            self.doc_count += stats["total"]
        self.emit("indexed", self.doc_count)
        return self.doc_count

    def chase(self, id: str) -> None:
        """Fill a new version from the beginning of the log, in passes of whatever size, and let it take the old one's place."""
        while self.run_pass([id]):
            pass
        if not self.catalog.is_failed(id):
            self.catalog.promote(id)

    def drain(self, ids: list[str] | None = None, seconds: float | None = None) -> bool:
        """Passes until nothing is left, or the time is over; whether nothing is left."""
        ids = self.catalog.ids() if ids is None else ids
        end = None if seconds is None else time.monotonic() + seconds
        for id in ids:
            if not self.catalog.is_promoted(id) and not self.catalog.is_failed(id):
                self.chase(id)
        while self.run_pass([i for i in ids if self.catalog.is_promoted(i)], self.pass_rows):
            if end is not None and time.monotonic() > end:
                return False
        return True

    def entries(self, id: str) -> DataFrame:
        """(id, seq, s, n, d): an index's entries as they serve queries, one for each document in it."""
        return indexes.current_entries(self.store.entries(id, self.catalog.serving(id)))

    def put(self, index: IndexDef, mapper: Callable[[object], dict | None] | None = None) -> None:
        if mapper is not None:
            self.mappers[index.python or index.id] = mapper
        if index.python is not None and index.python not in self.mappers:
            raise ValueError(f"no function {index.python!r} is registered")
        self.catalog.put(index)
