"""Vector clocks as MAP<STRING, BIGINT> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def same(a: Column, b: Column) -> Column:
    return F.array_sort(F.map_entries(a)) == F.array_sort(F.map_entries(b))


def descends(child: Column, parent: Column) -> Column:
    """The child has seen all that the parent has."""
    return F.forall(F.map_entries(parent), lambda e: F.coalesce(child[e["key"]], F.lit(0)) >= e["value"])


def increment(clock: Column, actor: Column) -> Column:
    bumped = F.map_from_arrays(F.array(actor), F.array(F.coalesce(clock[actor], F.lit(0)) + 1))
    return F.map_zip_with(F.coalesce(clock, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))), bumped, lambda _, old, new: F.coalesce(new, old))


def client_status(current: Column, supplied: Column) -> Column:
    """write or conflict, for a client that supplies the history it has seen (null: none)."""
    fine = current.isNull() | same(current, supplied) | descends(supplied, current)
    return F.when(F.coalesce(fine, F.lit(False)), "write").otherwise("conflict")


def replication_status(current: Column, candidate: Column) -> Column:
    """write, skip or conflict, for a version that another server sends."""
    return (
        F.when(current.isNull(), "write")
        .when(F.coalesce(same(current, candidate), F.lit(False)), "skip")
        .when(F.coalesce(descends(candidate, current), F.lit(False)), "write")
        .when(F.coalesce(descends(current, candidate), F.lit(False)), "skip")
        .otherwise("conflict")
    )
