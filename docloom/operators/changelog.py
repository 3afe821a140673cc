"""Logs of changes: snapshots, feeds, overlays, bulk operations, merges of replicas, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vclock

PAGE = 1024


def latest(log: DataFrame, key: str, seq: str | Column) -> DataFrame:
    """The last row of each key. Maxima are formed before rows are shuffled, so a key with many versions is no burden."""
    row = F.struct(*[F.col(c) for c in log.columns if c != key])
    return log.groupBy(key).agg(F.max_by(row, F.col(seq) if isinstance(seq, str) else seq).alias("__row")).select(key, "__row.*")


def snapshot(log: DataFrame, key: str = "id", seq: str = "seq", deleted: str = "deleted") -> DataFrame:
    return latest(log, key, seq).filter(~F.col(deleted))


def by_id(df: DataFrame, id: object, key: str = "id") -> DataFrame:
    return df.filter(F.col(key) == id)


def by_prefix(df: DataFrame, prefix: str, key: str = "id") -> DataFrame:
    return df.filter(F.col(key).startswith(prefix)).orderBy(key)


def seek(df: DataFrame, start: object, key: str = "id") -> DataFrame:
    return df.filter(F.col(key) >= start).orderBy(key)


def after(log: DataFrame, position: int, key: str = "id", seq: str = "seq", limit: int | None = PAGE) -> DataFrame:
    """Keys that changed strictly after a position, each once, by their first change there."""
    out = log.filter(F.col(seq) > position).groupBy(key).agg(F.min(seq).alias(seq)).orderBy(seq)
    return out if limit is None else out.limit(limit)


def feed(log: DataFrame, position: int, key: str = "id", seq: str = "seq", limit: int | None = PAGE) -> DataFrame:
    """The latest version of each key that changed after a position, by its latest change; deletions are in it."""
    out = latest(log.filter(F.col(seq) > position), key, seq).orderBy(seq)
    return out if limit is None else out.limit(limit)


def overlay(base: DataFrame, staged: DataFrame, key: str = "id", deleted: str = "deleted") -> DataFrame:
    """What a transaction reads: staged rows over the base, staged deletions hidden."""
    live = staged.filter(~F.col(deleted)).drop(deleted)
    return base.join(staged.select(key), key, "left_anti").unionByName(live)


def last_wins(ops: DataFrame, key: str, *order: str) -> DataFrame:
    """Bulk operations with one row a key: the last."""
    return latest(ops, key, F.struct(*order))


def merge(current: DataFrame, incoming: DataFrame, key: str = "id", history: str = "history") -> DataFrame:
    """Each key of two replicas with ``status``: keep, write, skip or conflict. Columns of the incoming row have the prefix ``in_``."""
    other = incoming.select(*[F.col(c).alias(f"in_{c}") for c in incoming.columns])
    joined = current.join(other, F.col(key) == F.col(f"in_{key}"), "full_outer")
    status = F.when(F.col(f"in_{key}").isNull(), "keep").otherwise(vclock.replication_status(F.col(history), F.col(f"in_{history}")))
    return joined.withColumn("status", status)


def merged(both: DataFrame, columns: list[str]) -> DataFrame:
    """The replica after a merge: incoming rows where they are written, current ones elsewhere."""
    wins = F.col("status") == "write"
    return both.select(*[F.when(wins, F.col(f"in_{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def without_conflicts(conflicts: DataFrame, id: object, key: str = "id") -> DataFrame:
    """All conflicts but those of exactly this id."""
    return conflicts.filter(F.col(key) != id)


def positions(log: DataFrame, seq: str = "seq") -> DataFrame:
    return log.agg(F.min(seq).alias("oldest"), F.max(seq).alias("newest"), F.count("*").alias("total"))
