"""Streams over a log of versions in a Parquet directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import changelog, indexes, rates
from ..operators.indexes import Catalog, IndexDef
from ..sources.store import LOG


def read_log(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, continuous: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer if continuous else writer.trigger(availableNow=True)
    return writer.start()


def follow_index(spark: SparkSession, log_path: str, index: IndexDef, out: str, checkpoint: str, continuous: bool = False, state: Catalog | None = None) -> StreamingQuery:
    """Keep an index up to date; with ``state`` its position is stored there, and nothing is done once it has failed there.

    Each batch writes what changed to a directory of its own, so a batch that
    runs again replaces its own rows and nothing else; ``read_index`` takes the
    latest row of each id. A changed definition belongs in a new ``out``, which
    replaces the old one once it has caught up.
    """

    def each(batch: DataFrame, number: int) -> None:
        if state is not None and state.is_failed(index.id):
            return
        last = changelog.latest(batch, "id", "seq")
        docs = last.filter("not deleted").withColumn("doc", F.parse_json("doc"))
        built = indexes.build(docs, index, "id")
        rows = last.select("id", "seq").join(built.withColumn("present", F.lit(True)), "id", "left")
        rows.withColumn("present", F.coalesce("present", F.lit(False))).write.mode("overwrite").parquet(f"{out}/batch={number}")
        if state is not None:
            state.advance(index.id, batch.agg(F.max("seq")).first()[0] or 0)

    return _run(read_log(spark, log_path), each, checkpoint, continuous)


def read_index(spark: SparkSession, out: str) -> DataFrame:
    rows = spark.read.option("basePath", out).parquet(out)
    return changelog.latest(rows, "id", "seq").filter("present").drop("present", "batch", "seq")


def follow_replica(spark: SparkSession, log_path: str, target, checkpoint: str, continuous: bool = False) -> StreamingQuery:
    """Bring another server's log into ``target``, a Database. A batch that runs again is skipped by its clocks."""
    return _run(read_log(spark, log_path), lambda batch, _: target.replicate(batch), checkpoint, continuous)


def follow_rates(events: DataFrame, checkpoint: str, name: str, seconds: int = 1, watermark: str = "10 seconds", **columns: str) -> StreamingQuery:
    """Rates of a stream of events, in a table in memory, once their windows are over."""
    out = rates.rates(events, seconds=seconds, watermark=watermark, **columns)
    return out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
