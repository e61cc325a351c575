"""Mixing sources to target weights, in DataFrame and SQL functions only.

Tokens are aggregated per source, targets are set by weight under a cap, the repetition rate of a source is its target over
its size, and each document comes floor(rate) times and once more with the fraction's probability, drawn from a hash of its
doc_id and the seed, so that reruns and retried tasks agree.

Null texts have size 0 and null sources are a source of their own, sorted last. A source without words has target 0. Repeated
rows of a doc_id draw alike. Texts of any length count whole; an empty table has no sources and gives no rows. Extra columns pass
through `mix`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from evisim.llm.staging import staged
from evisim.llm.words import n_words

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: A table of sources of this many rows at most is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 50_000


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, weight, target of sizes(source, size).

    Sources in code-point order take the weights in turn. Targets are level * weight, no more than most * source_size, with
    the level at which they sum to share of all sizes: the same as resharing every excess by weight. The windows run over one
    row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    per = per.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    free = F.col("level") * F.col("weight") < F.col("cap")
    # Of sources by cap / weight the first that stays under its cap has the level; those after it would get less.
    per = per.withColumn("at", F.max(F.when(free, F.col("level"))).over(everything))
    target = F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("at") * F.col("weight")))
    return per.select("source", "source_size", "weight", target.alias("target"))


def draw(seed: str, *ids: str) -> Column:
    """A double in [0, 1) from 52 bits of md5 over seed and ids."""
    key = F.concat_ws(":", F.lit(seed), *[F.coalesce(F.col(i).cast("string"), F.lit("null")) for i in ids])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def assign_copies(sizes: DataFrame, targets: DataFrame, seed: str = "mix-1") -> DataFrame:
    """sizes with source_size, target and `copies`."""
    few = targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    right = targets.select(F.col("source").alias("__s"), "source_size", "target")
    joined = sizes.join(F.broadcast(right) if few else right, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    return joined.withColumn("copies", (whole + F.when(draw(seed, "doc_id") < rate - whole, 1).otherwise(0)).cast("long"))


def plan_mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = "mix-1") -> DataFrame:
    """doc_id, source, size, source_size, target, copies of every row. Texts are read once, for their sizes."""
    sizes = staged(docs.select("doc_id", "source", n_words().alias("size")), "mix-sizes")
    targets = staged(source_targets(sizes, weights, share, most), "mix-targets")
    return assign_copies(sizes, targets, seed)


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = "mix-1") -> DataFrame:
    """docs, each row as often as the mix takes it. Texts don't move: each row is repeated where it was read."""
    names = [f"__c{i}" for i in range(len(docs.columns))]
    at = {c: names[i] for i, c in enumerate(docs.columns)}
    sizes = staged(docs.select("source", n_words().alias("size")).groupBy("source").agg(F.sum("size").alias("size")), "mix-sizes")
    targets = staged(source_targets(sizes, weights, share, most), "mix-targets")
    rows = docs.toDF(*names).withColumns({"doc_id": F.col(at["doc_id"]), "source": F.col(at["source"])})
    out = assign_copies(rows, targets, seed).filter("copies > 0").withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
