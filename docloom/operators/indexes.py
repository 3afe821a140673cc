"""User-defined and partial indexes: definition, build, statistics, failure."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import changelog, flatten

#: Fixed values of the rule by which an index fails: over so many documents, over this part of them in error.
FAIL_OVER, FAIL_RATIO = 100, 0.8
MOST_INDEXES = 10_000
DEFAULT = "default"


class IndexNotFound(KeyError):
    pass


@dataclass(frozen=True)
class IndexDef:
    """``fields``: SQL expressions by field name. ``where``: SQL condition of a partial index. Definitions are never evaluated as Python.

    ``python``: the name of a registered function that maps a document instead; ``fields`` are its fields' types then.
    """

    id: str
    fields: tuple[tuple[str, str], ...] = ()
    where: str | None = None
    python: str | None = None

    @staticmethod
    def of(id: str, fields: dict[str, str], where: str | None = None, python: str | None = None) -> IndexDef:
        return IndexDef(id, tuple(fields.items()), where, python)


def build(df: DataFrame, index: IndexDef, id_col: str) -> DataFrame:
    """(id, fields...): rows that the condition leaves out, or all of whose fields are null, aren't in the index."""
    rows = df if index.where is None else df.filter(F.expr(index.where))
    out = rows.select(F.col(id_col).alias("id"), *[F.expr(e).alias(f) for f, e in index.fields])
    present = F.coalesce(*[F.col(f"`{f}`").cast("string") for f, _ in index.fields])
    return out.filter(present.isNotNull())


def build_python(df: DataFrame, id_col: str, mapper: Callable[[dict], dict | None], fields: str, where: Callable[[dict], bool] | None = None) -> DataFrame:
    """(id, fields..., error): an index by a Python function of the row, in Arrow batches; what it raises is kept with its row."""
    names = [x.split()[0] for x in fields.split(",")]
    schema = f"{df.select(F.col(id_col).alias('id')).schema.simpleString()[7:-1].replace(':', ' ')}, {fields}, error string"

    def run(frames: Iterable):
        import pandas as pd

        for frame in frames:
            rows = []
            for doc in frame.to_dict("records"):
                try:
                    found = mapper(doc) if where is None or where(doc) else None
                    if found is not None:
                        rows.append((doc[id_col], *[found.get(n) for n in names], None))
                except Exception as e:  # noqa: BLE001  counted, and the document's old entry stays
                    rows.append((doc[id_col], *[None] * len(names), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["id", *names, "error"])

    return df.mapInPandas(run, schema)


def upsert(old: DataFrame, changed: DataFrame, new: DataFrame) -> DataFrame:
    """Index rows after a pass: ``changed`` ids lose their old rows, ``new`` ones are added."""
    return old.join(changed.select("id").distinct(), "id", "left_anti").unionByName(new)


_MAPS = ("s", "n", "d")


def _entries(changes: DataFrame, mapped: DataFrame, fields: DataFrame) -> DataFrame:
    """(id, seq, present, s, n, d, error) of all that changed. ``mapped``: ids that are in the index, or ``error``. ``fields``: what they have there."""
    out = changes.select("id", "seq").join(mapped.select("id", F.lit(True).alias("__in"), "error"), "id", "left").join(fields, "id", "left")
    return out.select("id", "seq", (F.coalesce("__in", F.lit(False)) & F.col("error").isNull()).alias("present"), *_MAPS, "error")


def default_entries(changes: DataFrame) -> DataFrame:
    """Entries of the index that has every value of every document. ``changes``: id, seq, deleted, doc as VARIANT, json."""
    live = changes.filter("not deleted")
    return _entries(changes, live.select("id", F.lit(None).cast("string").alias("error")), flatten.regroup(flatten.variant_entries(live, "id", "doc")))


def sql_entries(changes: DataFrame, index: IndexDef) -> DataFrame:
    """Entries of an index by SQL expressions over id, doc and json."""
    built = build(changes.filter("not deleted"), index, "id").withColumnsRenamed({f: f"f_{f}" for f, _ in index.fields})
    fields = flatten.entries(built, "id").withColumn("field", F.substring("field", 3, 1 << 30))
    return _entries(changes, built.select("id", F.lit(None).cast("string").alias("error")), flatten.regroup(fields))


def python_entries(changes: DataFrame, index: IndexDef, mapper: Callable[[object], dict | None]) -> DataFrame:
    """Entries of an index by a Python function of the document; a document for which it raises has ``error``."""
    live = changes.filter("not deleted") if index.where is None else changes.filter("not deleted").filter(F.expr(index.where))
    names = {f: f"f_{f}" for f, _ in index.fields}

    def of_row(row: dict) -> dict | None:
        found = mapper(json.loads(row["json"]))
        return None if found is None else {names[k]: v for k, v in found.items() if k in names}

    built = build_python(live.select("id", "json"), "id", of_row, ", ".join(f"{names[f]} {t}" for f, t in index.fields))
    fields = flatten.entries(built.filter("error is null").drop("error"), "id").withColumn("field", F.substring("field", 3, 1 << 30))
    return _entries(changes, built.select("id", "error"), flatten.regroup(fields))


def current_entries(entries: DataFrame) -> DataFrame:
    """(id, seq, s, n, d) of the documents in an index: each one's last entry that was mapped without an error, if it has one."""
    return changelog.latest(entries.filter("error is null").drop("error"), "id", "seq").filter("present").select("id", "seq", *_MAPS)


def is_failing(total: int, errors: int, over: int = FAIL_OVER, ratio: float = FAIL_RATIO) -> bool:
    return total > over and errors / total > ratio


def stats(mapped: DataFrame, index_id: Column, error: Column) -> DataFrame:
    """(index_id, total, errors, indexed) of mapped documents, of which ``error`` is true where mapping failed."""
    return mapped.groupBy(index_id.alias("index_id")).agg(F.count("*").alias("total"), F.count_if(error).alias("errors"), F.count_if(~error).alias("indexed"))


def pass_stats(changes: DataFrame, defs: DataFrame, error: Column) -> DataFrame:
    """Statistics of one pass of several indexes over the same documents: each row of ``changes`` meets each of ``defs``.

    ``defs`` has a row for each index (index_id, ...), of which there are few: they are counted before they are sent to all.
    """
    if defs.count() > MOST_INDEXES:
        raise ValueError(f"more than {MOST_INDEXES} indexes in a pass")
    return stats(changes.join(F.broadcast(defs)), F.col("index_id"), error)


def failed(stats: DataFrame, over: int = FAIL_OVER, ratio: float = FAIL_RATIO) -> DataFrame:
    return stats.filter((F.col("total") > over) & (F.col("errors") / F.col("total") > ratio))


class Catalog:
    """Definitions by id, with state. Positions and failures are kept beside them.

    ``rows`` are what an earlier catalog gave to ``save``, the last of each id;
    every change is saved as a row of its own.
    """

    def __init__(self, rows: Iterable[dict] = (), save: Callable[[dict], None] | None = None) -> None:
        self._defs: dict[str, IndexDef] = {}
        self._state: dict[str, dict] = {}
        self._save, self._at = save, 0
        for r in rows:
            self._at = max(self._at, r["at"])
            if not r["deleted"]:
                self._defs[r["id"]] = IndexDef(r["id"], tuple((f["name"], f["expression"]) for f in r["fields"]), r["condition"], r.get("python"))
                self._state[r["id"]] = {"version": r["version"], "last_seq": r["last_seq"], "failed": r["failed"], "serving": r.get("serving") or 0}
        self._defs.setdefault(DEFAULT, IndexDef(DEFAULT))
        self._state.setdefault(DEFAULT, {"version": 1, "last_seq": 0, "failed": False, "serving": 1})

    def _changed(self, index: IndexDef, state: dict, deleted: bool = False) -> None:
        self._at += 1
        if self._save is not None:
            fields = [{"name": f, "expression": e} for f, e in index.fields]
            self._save({"id": index.id, "at": self._at, "fields": fields, "condition": index.where, "python": index.python, **state, "deleted": deleted})

    def put(self, index: IndexDef) -> None:
        """A definition that changes starts from the beginning of the log, as a new version."""
        if self._defs.get(index.id) == index:
            return
        version = self._state.get(index.id, {}).get("version", 0)
        self._defs[index.id] = index
        self._set(index.id, version=version + 1, last_seq=0, failed=False)

    def version(self, id: str) -> int:
        return self._state[id]["version"]

    def last_seq(self, id: str) -> int:
        return self._state[id]["last_seq"]

    def serving(self, id: str) -> int:
        """The version that serves queries: the newest only if it has caught up once, or is the first."""
        self.get(id)
        return self._state[id]["serving"] or self.version(id)

    def is_promoted(self, id: str) -> bool:
        return self._state[id]["serving"] == self.version(id)

    def promote(self, id: str) -> None:
        self._set(id, serving=self.version(id))

    def _set(self, id: str, **state: object) -> None:
        index = self.get(id)
        self._state[id] = {"serving": 0} | self._state.get(id, {}) | state
        self._changed(index, self._state[id])

    def get(self, id: str) -> IndexDef:
        if id not in self._defs:
            raise IndexNotFound(id)
        return self._defs[id]

    def metadata(self, id: str) -> dict:
        self.get(id)
        return {k: v for k, v in self._state[id].items() if k != "serving"}

    def delete(self, id: str) -> None:
        index = self.get(id)
        if id == DEFAULT:
            raise ValueError("the built-in index can't be deleted")
        self._changed(index, self._state[id], deleted=True)
        del self._defs[id], self._state[id]

    def ids(self) -> list[str]:
        """The built-in index and the stored ones."""
        return [DEFAULT, *sorted(set(self._defs) - {DEFAULT})]

    def mark_failed(self, id: str) -> None:
        self._set(id, failed=True)

    def is_failed(self, id: str) -> bool:
        return self.metadata(id)["failed"]

    def advance(self, id: str, seq: int) -> None:
        if seq > self.metadata(id)["last_seq"]:
            self._set(id, last_seq=seq)

    def reset(self, id: str) -> None:
        self._set(id, last_seq=0, failed=False)
