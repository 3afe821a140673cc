"""CSV sources with fixed positional schemas, and sequential ids for what is loaded."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.scalars import read_float, read_int

#: Column names by position, and how they are read.
PRESCRIPTION = {"sha": "s", "pct": "s", "practice": "s", "bnf-code": "s", "bnf-chemical": "s", "bnf-name": "s", "items": "f", "net-ingredient-cost": "f", "act-cost": "f", "quantity": "i", "year": "i", "month": "i"}
GP = (
    "organisation-code", "name", "national-grouping", "high-level-health-authority", "address-1", "address-2", "address-3", "address-4", "address-5", "postcode",
    "open-date", "close-date", "status-code", "org-sub-type-code", "parent-org-code", "join-parent-date", "left-parent-date", "contact-telephone", "amend-record-indicator", "practice-type",
)
BATCH = 250


def _raw(spark: SparkSession, path: str, n: int, header: bool) -> DataFrame:
    names = [f"_{i}" for i in range(n)]
    return spark.read.csv(path, schema=T.StructType([T.StructField(c, T.StringType()) for c in names]), header=header)


def prescriptions(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """Twelve columns: trimmed texts, floats, and integers that are read as floats and cut off."""
    read = {"s": F.trim, "f": read_float, "i": read_int}
    raw = _raw(spark, path, len(PRESCRIPTION), header)
    return raw.select(*[read[kind](F.col(f"_{i}")).alias(name) for i, (name, kind) in enumerate(PRESCRIPTION.items())])


def texts(spark: SparkSession, path: str, names: list[str], header: bool = False) -> DataFrame:
    """Trimmed texts by position."""
    raw = _raw(spark, path, len(names), header)
    return raw.select(*[F.trim(F.col(f"_{i}")).alias(n) for i, n in enumerate(names)])


def practices(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """General practices: twenty trimmed texts."""
    return texts(spark, path, list(GP), header)


def load(db, rows: DataFrame, prefix: str, batch: int = BATCH) -> int:
    """Write rows as documents ``prefix-1``, ... in commits of ``batch``; how many. For small files: rows pass through the driver, a few at a time."""
    numbered = with_sequential_ids(rows, prefix, "__id").select("__id", F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("__doc"))
    ops, total = [], 0
    for r in numbered.toLocalIterator():
        ops.append({"operation": "docs-put", "id": r["__id"], "document": json.loads(r["__doc"])})
        if len(ops) == batch:
            db.bulk(ops)
            total, ops = total + len(ops), []
    if ops:
        db.bulk(ops)
    return total + len(ops)


def with_sequential_ids(df: DataFrame, prefix: str, id_col: str = "id") -> DataFrame:
    """Ids ``prefix-1``, ``prefix-2``, ... in the order of the input.

    Rows are numbered within their partition, and only the partitions' counts
    (a row each) meet to give their offsets.
    """
    part = df.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    counts = part.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__part", before.alias("__before"))
    # Ids of partition p begin at p * 2**33, so a row's number within it is what is left.
    numbered = part.join(F.broadcast(offsets), "__part").withColumn(id_col, F.concat(F.lit(f"{prefix}-"), (F.col("__before") + F.col("__at") % F.lit(1 << 33) + 1).cast("string")))
    return numbered.drop("__part", "__at", "__before")
