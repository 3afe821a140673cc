"""Exact top-k inner-product search by MaxScore, over vectors of integers.

Rows are packed into blocks of vectors; blocks of queries meet shards of
candidates, and each query keeps its k best of each shard, which are merged at
the end. Within a shard a dimension is a term, its column of values the term's
postings. A term's contribution to a score lies between two bounds known for the
shard, and terms are ordered by how far apart these are. A query's threshold is a
score that k candidates are known to reach. It starts from the k best scores of
the shards that the same task has done before and the true scores of a sample of
this shard, and rises as postings are traversed. A shard whose bounds don't reach
the threshold is skipped. Terms are essential until what is left, the
non-essential ones, can't lift a candidate that is at its least in all essential
ones to the threshold; the split moves as the threshold rises. Essential postings are traversed for
all candidates; then the most promising ones are scored in full, which raises the
threshold again, and non-essential postings are probed only for candidates that
are still competitive.

Queries and candidates are both dealt out in blocks, so neither is broadcast;
each query block visits each shard once, which an exact search without an
index must do.

Defined results: vectors that are null, or have null or non-finite components,
and rows without an id, take no part; shorter vectors count as padded with 0;
of equal scores the smaller id comes first; a query never finds rows with its
own id; repeated rows each count as candidates, and repeated queries give the
same answer once. Fewer than k candidates give fewer rows.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, partitions, schema, sliced

SHARD, QUERIES, PROBE_STEP, BLOCKS_KEPT = 4096, 1024, 16, 64


def quantized(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id and the vector of floor(scale * x), of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * F.lit(scale)).cast("long")).alias("v"))


def pack(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most ``size`` rows: ids and a matrix, as bytes of 64-bit integers."""
    out = schema("ids binary, matrix binary, dim int, n int")

    def run(batches):
        ids, vectors = [], []

        def block(m: int):
            dim = max(map(len, vectors[:m]), default=0)
            x = np.zeros((m, dim), np.int64)
            for i, v in enumerate(vectors[:m]):
                x[i, : len(v)] = v
            got = [np.array(ids[:m], np.int64).tobytes()], [x.tobytes()], [dim], [m]
            del ids[:m], vectors[:m]
            return pa.RecordBatch.from_arrays([pa.array(got[0], pa.binary()), pa.array(got[1], pa.binary()), pa.array(got[2], pa.int32()), pa.array(got[3], pa.int32())], out.names)

        for batch in batches:
            ids += batch.column("vec_id").to_pylist()
            vectors += batch.column("v").to_pylist()
            while len(ids) >= size:
                yield block(size)
        if ids:
            yield block(len(ids))

    return rows.mapInArrow(run, out)


def _matrix(ids: bytes, matrix: bytes, dim: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(matrix, np.int64).reshape(n, dim)


def _kth(values: np.ndarray, k: int):
    """The k-th highest value; None if there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else None


def maxscore(queries: tuple[np.ndarray, np.ndarray], shard: tuple[np.ndarray, np.ndarray], k: int, best: list[list[int]] | None = None, step: int = PROBE_STEP) -> list[tuple[int, int, int]]:
    """(query id, candidate id, score) of each query's k best in the shard, without those that can't be among its k best of all.

    ``best`` has each query's k highest scores in the shards done before, which this call brings up to date.
    """
    qids, q = queries
    ids, x = shard
    dim = min(q.shape[1], x.shape[1])
    q, x = q[:, :dim], x[:, :dim]
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    high = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * max(dim, 1)
    if high >= 2**62:
        kind = object
    else:
        kind = np.float64 if high < 2**53 else np.int64  # sums of this size are exact in doubles, which multiply faster
    cols = np.ascontiguousarray(x.T).astype(kind)  # postings: a term's values, by candidate
    low_x, high_x = (cols.min(1), cols.max(1)) if len(ids) and dim else (np.zeros(dim), np.zeros(dim))
    best = [[] for _ in qids] if best is None else best
    out = []
    for at_query, (qid, v) in enumerate(zip(qids.tolist(), q.astype(kind), strict=True)):
        before = best[at_query]
        least = before[-1] if len(before) == k else None
        a, b = v * low_x, v * high_x
        upper, lower = np.maximum(a, b), np.minimum(a, b)
        terms = np.argsort(-(upper - lower).astype(float), kind="stable")
        # What the terms from each on can add at most, and do add at least.
        rest, sure = (np.concatenate([np.cumsum(e[terms][::-1])[::-1], [0]]) for e in (upper, lower))
        alive = np.flatnonzero(ids != qid)
        if not len(alive) or (least is not None and rest[0] < least):
            continue
        true = _kth(v @ cols[:, alive[:: max(1, len(alive) // (4 * k))]], k)
        least = true if least is None or (true is not None and true > least) else least
        weakest = sure[0] - sure + rest  # of a candidate at its least in the terms before each, and at its most from there on
        score = np.zeros(len(ids), kind)
        at, probing = 0, False
        while at < dim and len(alive):
            if not probing and least is not None and weakest[at] < least:
                probing = True  # the rest is non-essential
                top = alive if len(alive) <= 4 * k else alive[np.argpartition(score[alive], len(alive) - 4 * k)[-4 * k :]]
                true = _kth(score[top] + v[terms[at:]] @ cols[np.ix_(terms[at:], top)], k)
                least = true if true is not None and true > least else least
            if probing:
                alive = alive[score[alive] + rest[at] >= least]
            some = terms[at : at + step]
            if len(alive) == len(ids):
                score += v[some] @ cols[some]
            else:
                score[alive] += v[some] @ cols[np.ix_(some, alive)]
            at += len(some)
            reached = _kth(score[alive] + sure[at], k)
            least = reached if reached is not None and (least is None or reached > least) else least
        final = score[alive]
        top = np.lexsort((ids[alive], -final))[:k]
        out += [(qid, int(ids[alive[i]]), int(final[i])) for i in top]
        best[at_query] = sorted(before + [int(final[i]) for i in top], reverse=True)[:k]
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 5, shard: int = SHARD, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best. ``vectors``: vec_id and v, an array of integers."""
    spark = vectors.sparkSession
    vectors = materialize(vectors, "vectors")
    n = partitions(spark)
    # Round-robin dealing evens out the shards, whatever the files look like.
    shards = materialize(pack(vectors.repartition(n), shard), "shards")
    asked = vectors.filter(is_query).dropDuplicates(["vec_id", "v"])
    m = asked.count()
    # One block for each partition, so a block is known by its partition's number.
    n_blocks = max(1, -(-m // queries))
    blocks = pack(asked.repartition(n_blocks), 2 * queries)
    blocks = materialize(blocks.select(F.spark_partition_id().alias("block"), *[F.col(c).alias(f"q_{c}") for c in blocks.columns]), "queries")
    meet = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).join(blocks, "block")
    out = schema("query_id long, vec_id long, score long")

    def run(batches):
        best = {}  # of the blocks this task has met; without it, less is pruned
        for batch in sliced(batches, 1):
            for r in batch.to_pylist():
                key = r["block"], r["q_ids"]
                if key not in best and len(best) >= BLOCKS_KEPT:
                    best.clear()
                known = best.setdefault(key, [[] for _ in range(r["q_n"])])
                found = maxscore(_matrix(r["q_ids"], r["q_matrix"], r["q_dim"], r["q_n"]), _matrix(r["ids"], r["matrix"], r["dim"], r["n"]), k, known)
                cols = list(zip(*found, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], out.names)

    best = meet.mapInArrow(run, out)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
