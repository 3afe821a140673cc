"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: A word everywhere in this subpackage: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

BATCH_ROWS = 500

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that their Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_docloom_shipped", None) is None:
        root = Path(__file__).resolve().parents[1]
        to = Path(os.path.realpath(tempfile.mkdtemp(prefix="docloom-"))) / "docloom.zip"
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(to))
        # Rows here are whole texts: ten thousand in a batch would fill a worker's memory, and the JVM's buffers.
        if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        sc._docloom_shipped = to


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session without one, as in tests, gets a local folder."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts lineage so that a lost executor costs one table's tasks and no
    more, and gives the planner the true size, so that it broadcasts only what
    is under its own threshold.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{scratch(spark)}/docloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._docloom_path = path
    if (written := _WRITTEN.get()) is not None:
        written.append(out)
    return out


_WRITTEN: contextvars.ContextVar[list[DataFrame] | None] = contextvars.ContextVar("written", default=None)


@contextlib.contextmanager
def temporary() -> Iterator[list[DataFrame]]:
    """Tables that ``materialize`` writes inside are deleted in the end, but for those that are taken out of the list."""
    written: list[DataFrame] = []
    token = _WRITTEN.set(written)
    try:
        yield written
    finally:
        _WRITTEN.reset(token)
        discard(*written)


def kept(table: DataFrame, written: list[DataFrame]) -> DataFrame:
    """Take a table out of those that ``temporary`` deletes; tables around that belong to whoever is outside."""
    written[:] = [x for x in written if x is not table]
    return table


def discard(*frames: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more. Those that are gone already don't matter."""
    for df in frames:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._docloom_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Let go of shuffles that nothing refers to.

    Spark removes a finished job's shuffle files when the driver's JVM collects what stood for them, which it
    has little reason to do by itself: with a heap that doesn't fill, they would stay to the operator's end.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text modulo n; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(seed: str, *keys: Column) -> Column:
    """A uniform number in [0, 1) from the keys' text; 52 bits of an MD5 digest."""
    parts = [F.coalesce(k.cast("string"), F.lit("null")) for k in keys]
    digest = F.md5(F.concat_ws(":", F.lit(seed), *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add, for each name in ``sums``, the sum of its column over all earlier rows in the global order.

    Rows are dealt by ranges of ``order``, summed within each range, and moved
    by the totals of the ranges before. Only one row per range meets in one
    task. The range of each row is written before it is used, as ranges come
    from a sample and may differ when computed again.
    """
    n = partitions(df.sparkSession)
    dealt = df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id())
    for k, v in sums.items():
        dealt = dealt.withColumn(f"__v_{k}", v)
    dealt = materialize(dealt, "ranges")
    before = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("__range").agg(*[F.sum(f"__v_{k}").alias(f"__t_{k}") for k in sums])
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__range", *[F.coalesce(F.sum(f"__t_{k}").over(earlier), F.lit(0)).alias(f"__o_{k}") for k in sums])
    out = dealt.select("*", *[F.coalesce(F.sum(f"__v_{k}").over(before), F.lit(0)).alias(f"__w_{k}") for k in sums])
    # At most one row for each of the n ranges, so this broadcast is bounded by the number of partitions.
    out = out.join(F.broadcast(offsets), "__range")
    return out.select(*df.columns, *[(F.col(f"__o_{k}") + F.col(f"__w_{k}")).alias(k) for k in sums])


def text_of(df: DataFrame, *more: str) -> DataFrame:
    """doc_id, the whole text with null as empty, and more columns; whatever else the table has stays out."""
    ship(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def keyed(df: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text; id and hash together name a document even if ids repeat."""
    return text_of(df).withColumn("th", F.xxhash64("text"))


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64 on an array of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(seed: int) -> np.ndarray:
    """256 pseudo-random odd 64-bit integers."""
    return mix64(np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def window_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of all runs of k values, by doubling the length; mixed, so that all bits are usable."""
    base = np.uint64(0x9E3779B97F4A7C15)
    n = len(x) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    done, out, power, length, factor = 0, None, x, 1, int(base)
    while True:
        if k & length:  # the hash of the first done values, followed by a run of this length
            if out is None:
                out = power[: len(x)]
            else:
                m = len(x) - done - length + 1
                out = out[:m] * np.uint64(factor) + power[done : done + m]
            done += length
        if done == k:
            return mix64(out[:n])
        m = len(power) - length
        power = power[:m] * np.uint64(factor) + power[length : length + m]
        factor = factor * factor % 2**64
        length *= 2


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTERS = byte_table(6)
_CHUNK = 1 << 20


def _powers() -> np.ndarray:
    out = np.full(1 << 16, 0x9E3779B97F4A7C15, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers()


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(data, np.uint8)
    gap = _SPACE[x]
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    first = np.concatenate([[0], np.cumsum(ends - starts)])
    place = np.arange(first[-1], dtype=np.int64) - np.repeat(first[:-1], ends - starts)
    value = _LETTERS[x[~gap]] * _POWERS[place & 0xFFFF]
    if int((ends - starts).max()) > 1 << 16:  # a word longer than the table: the power's high part comes from a second table
        high = np.full(int(place.max() >> 16) + 1, pow(0x9E3779B97F4A7C15, 1 << 16, 1 << 64), np.uint64)
        high[0] = 1
        value *= np.multiply.accumulate(high)[place >> 16]
    return starts, ends, mix64(np.add.reduceat(value, first[:-1]))


def hashed_words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of a text's words. Long texts are taken in chunks cut at white space."""
    at, parts = 0, []
    while at < len(text) or not parts:
        end = at + _CHUNK
        if end < len(text):
            cut = max(text.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            while cut < 0 and end < len(text):  # no white space at all: look further
                found = [i for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (i := text.find(c, end, end + _CHUNK)) >= 0]
                cut, end = min(found, default=-1), end + _CHUNK
            end = cut + 1 if cut >= 0 else len(text)
        starts, ends, h = _hash_words(text[at:end])
        parts.append((starts + at, ends + at, h))
        at = end
    return parts[0] if len(parts) == 1 else tuple(map(np.concatenate, zip(*parts, strict=True)))


def word_hashes_of(texts: list[bytes]) -> list[np.ndarray]:
    """The hashes of each text's words, in order; short texts are hashed together."""
    out: list[np.ndarray] = []
    held, used = [], 0

    def together() -> None:
        starts, _, h = _hash_words(b"\n".join(held))
        at = np.searchsorted(starts, np.cumsum([0, *[len(t) + 1 for t in held]])).tolist()
        out.extend(h[a:b] for a, b in zip(at[:-1], at[1:], strict=True))
        held.clear()

    for text in texts:
        if held and used + len(text) > _CHUNK:
            together()
            used = 0
        if len(text) > _CHUNK:
            out.append(hashed_words(text)[2])
        else:
            held.append(text)
            used += len(text)
    if held:
        together()
    return out


def release() -> None:
    """Give memory that a task has freed back to the system; workers live on, and executors are small."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


_KEPT: dict[str, Callable[[], object]] = {}


def begin(operator: str, clear: Callable[[], object] | None = None) -> None:
    """Called first in a task. Workers live on from operator to operator: what others keep in this one is let go by their ``clear``."""
    others = [name for name in _KEPT if name != operator]
    for name in others:
        _KEPT.pop(name)()
    if others:
        gc.enable()
        gc.collect()
        release()
    if clear is not None:
        _KEPT[operator] = clear


def sliced(batches: Iterable, rows: int) -> Iterator:
    """Arrow batches of at most so many rows, without copies: what Python makes of one is gone before the next."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    release()


def pieces(batches: Iterable, limit: int, *columns: str) -> Iterator[list[tuple]]:
    """Rows of Arrow batches in lists with at most ``limit`` bytes in the last column (one row at least)."""
    held, used = [], 0
    for batch in sliced(batches, 256):
        cols = [batch.column(c) for c in columns]
        for row in zip(*(c.to_pylist() for c in cols), strict=True):
            n = len(row[-1]) if row[-1] is not None else 0
            if held and used + n > limit:
                yield held
                held, used = [], 0
            held.append(row)
            used += n
    if held:
        yield held
