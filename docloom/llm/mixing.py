"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed per source, targets are solved over the small table of
sources, and each document is repeated floor(rate) times plus one hash-seeded
Bernoulli copy with the rate's fraction as its probability.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; a source without words has target 0 and its documents stay
once; rows that repeat an id draw alike; an empty table gives no rows. Columns
of the input that happen to bear an output's name don't disturb ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, prefix_sums, unit_hash, word_count

SEED = "mix-1"


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets of the sources in a table (source, source_size).

    Sources take the weights in turn, by code point, null last. They share
    ``share`` times all words; none goes over ``cap`` times its own, and what
    is over is shared again by weight until none is above. In order of
    cap / weight the capped sources come first, so one pass of prefix sums
    finds the level at which the rest share, without rounds.
    """
    null_last = [F.col("source").isNull(), F.col("source")]
    order = prefix_sums(sources, null_last, {"__rank": F.lit(1)})
    turn = F.col("__rank") % len(weights)
    weight = F.lit(weights[-1])
    for i, w in enumerate(weights[:-1]):
        weight = F.when(turn == i, F.lit(w)).otherwise(weight)
    order = order.select("source", "source_size", weight.cast("double").alias("__w"), (F.col("source_size") * F.lit(cap)).alias("__cap"))
    order = prefix_sums(order, [F.col("__cap") / F.col("__w"), *null_last], {"__capped": F.col("__cap"), "__weights": F.col("__w")})
    order = materialize(order, "sources")
    words, weight_sum = order.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("__w"), F.lit(0.0))).first()
    level = (F.lit(words * share) - F.col("__capped")) / (F.lit(weight_sum) - F.col("__weights"))
    # Levels fall short of cap / weight from the first source on that isn't capped: its level is the common one.
    free = F.col("__cap") > level * F.col("__w")
    common = order.filter(free).agg(F.min_by(level, F.col("__weights"))).first()[0]
    target = F.col("__cap") if common is None else F.least(F.col("__cap"), F.lit(common) * F.col("__w"))
    return order.select("source", "source_size", target.alias("target"))


def copies(size: Column, source_size: Column, target: Column, *key: Column, cap: float = 2.0, seed: str = SEED) -> Column:
    """floor(rate) plus a Bernoulli copy with the fraction as probability."""
    rate = F.when(source_size > 0, F.least(target / source_size, F.lit(cap))).otherwise(F.lit(1.0))
    return (F.floor(rate) + F.when(unit_hash(seed, *key) < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def draw(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (words, repeats counted) of each document."""
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    sizes = materialize(sizes, "sizes")  # texts are read once
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sources, weights, share, cap), "targets").withColumnRenamed("source", "__source")
    # The planner broadcasts the written table if it is under its threshold; else adaptive execution splits a hot source.
    out = sizes.join(targets, F.col("source").eqNullSafe(F.col("__source")), "left")
    out = out.withColumn("copies", copies(F.col("size"), F.col("source_size"), F.col("target"), F.col("doc_id"), cap=cap, seed=seed))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = SEED) -> DataFrame:
    """The mix itself: every row of ``docs``, with all its columns, as often as it was drawn."""
    own = docs.columns
    sized = docs.select(F.col("source").alias("__source"), word_count(F.col("text")).alias("__size"))
    sources = materialize(sized.groupBy(F.col("__source").alias("source")).agg(F.sum("__size").alias("source_size")), "sources")
    targets = materialize(source_targets(sources, weights, share, cap), "targets")
    targets = targets.select(*[F.col(c).alias(f"__t_{c}") for c in targets.columns])
    # The join's own key column carries the source, so no column of docs can clash with it.
    n = copies(F.lit(0), F.col("__t_source_size"), F.col("__t_target"), docs["doc_id"], cap=cap, seed=seed)
    out = docs.join(targets, docs["source"].eqNullSafe(F.col("__t_source")), "left").withColumn("__n", n)
    out = out.filter(F.col("__n") > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    return out.select(*own)
