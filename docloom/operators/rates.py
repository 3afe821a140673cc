"""Counters and rates of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def totals(events: DataFrame, key: str = "event_type", amount: str | None = None) -> DataFrame:
    value = F.lit(1) if amount is None else F.col(amount)
    return events.groupBy(key).agg(F.sum(value).alias("total"))


def rates(events: DataFrame, ts: str = "ts", key: str = "event_type", amount: str | None = None, seconds: int = 1, watermark: str | None = None) -> DataFrame:
    """(start, key, total, rate): sums in tumbling windows over their seconds. With a watermark it runs on streams as well."""
    value = F.lit(1) if amount is None else F.col(amount)
    rows = events if watermark is None else events.withWatermark(ts, watermark)
    out = rows.groupBy(F.window(ts, f"{seconds} seconds").alias("w"), key).agg(F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), key, "total", (F.col("total") / F.lit(float(seconds))).alias("rate"))
