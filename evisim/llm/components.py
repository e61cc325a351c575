"""Connected components of an edge table by contraction; every step is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evisim.llm.staging import discard, staged


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, root (smallest node reachable) of every node of edges(a, b).

    Each round sends a node to its smallest neighbour. Such steps have no cycles but of two nodes that choose each other, of
    which the smaller stays, so every tree has two nodes at least and a round halves the nodes of a component or better. Within
    the round pointers jump until they reach the root, which doubles their length each time: rounds and jumps are both in the
    logarithm of a component's size, for a path as for a star. A node's choice is a minimum that tasks take before the shuffle,
    and joins meet written tables on both sides, so that Spark splits hubs. Tables of past rounds are deleted.
    """
    edges = staged(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), label)
    home: DataFrame | None = None
    while not edges.isEmpty():
        step = _roots(edges, label)
        if home is None:
            home = step.withColumnRenamed("to", "root")
        else:
            jump = step.select(F.col("node").alias("n"), F.col("to").alias("t"))
            old, home = home, staged(home.join(jump, F.col("root") == F.col("n"), "left").select("node", F.coalesce("t", "root").alias("root")), label)
            discard(old)
        sa = step.select(F.col("node").alias("na"), F.col("to").alias("ta"))
        sb = step.select(F.col("node").alias("nb"), F.col("to").alias("tb"))
        moved = edges.join(sa, F.col("a") == F.col("na")).join(sb, F.col("b") == F.col("nb")).filter("ta <> tb")
        old, edges = edges, staged(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), label)
        discard(old)
    if home is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    lowest = staged(home.groupBy("root").agg(F.min("node").alias("low")), label).withColumnRenamed("root", "r")
    return home.join(lowest, F.col("root") == F.col("r")).select("node", F.col("low").alias("root"))


def _roots(edges: DataFrame, label: str) -> DataFrame:
    """node, to: the root of each node's tree when every node goes to its smallest neighbour."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    chosen = staged(both.groupBy("node").agg(F.min("other").alias("to")), label)
    back = chosen.select(F.col("node").alias("n"), F.col("to").alias("t"))
    mutual = (F.col("t") == F.col("node")) & (F.col("node") < F.col("to"))
    step = staged(chosen.join(back, F.col("to") == F.col("n")).select("node", F.when(mutual, F.col("node")).otherwise(F.col("to")).alias("to")), label)
    discard(chosen)
    while True:
        onward = step.select(F.col("node").alias("n"), F.col("to").alias("t")).filter("n <> t")
        jumped = staged(step.join(onward, F.col("to") == F.col("n"), "left").select("node", F.coalesce("t", "to").alias("to"), F.col("t").isNotNull().alias("moved")), label)
        moved = not jumped.filter("moved").isEmpty()
        discard(step)
        step = jumped.drop("moved")
        step._staged_at = jumped._staged_at
        if not moved:
            return step
