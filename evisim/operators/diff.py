"""Diff of two snapshots keyed by name, and its summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def version_diff(old: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    """Full outer equi-join on the key: status, sizes, size and instruction deltas.

    Instruction counts of 0 mean unknown: they give no delta and never make a row modified.
    """
    o = old.select(F.col(key).alias("ok"), F.col("size").alias("old_size"), F.col("instr_count").alias("oi"))
    n = new.select(F.col(key).alias("nk"), F.col("size").alias("new_size"), F.col("instr_count").alias("ni"))
    known = (F.col("oi") != 0) & (F.col("ni") != 0)
    same = (F.col("old_size") == F.col("new_size")) & (~known | (F.col("oi") == F.col("ni")))
    status = F.when(F.col("ok").isNull(), "added").when(F.col("nk").isNull(), "removed").when(same, "unchanged").otherwise("modified")
    return o.join(n, F.col("ok") == F.col("nk"), "full_outer").select(
        F.coalesce("ok", "nk").alias(key), status.alias("status"), "old_size", "new_size", (F.col("new_size") - F.col("old_size")).alias("size_delta"), F.when(known, F.col("ni") - F.col("oi")).alias("instr_delta")
    )


def diff_summary(diff: DataFrame) -> DataFrame:
    """Counts and size change by status, with a total row."""
    return diff.rollup("status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("size_delta", F.lit(0))).cast("long").alias("size_delta")).withColumn("status", F.coalesce("status", F.lit("total")))
