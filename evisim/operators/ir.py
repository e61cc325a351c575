"""Aggregates over instruction rows: def-use chains, lifetimes, histograms, classes, struct layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def def_use_chains(ops: DataFrame) -> DataFrame:
    """func, varnode, defs, uses (sorted, comma-joined) of ops(func, seq, output, inputs)."""
    d = ops.filter("output IS NOT NULL").select("func", F.col("output").alias("varnode"), F.lit("d").alias("k"), "seq")
    u = ops.select("func", F.explode("inputs").alias("varnode"), F.lit("u").alias("k"), "seq")
    both = d.unionByName(u.filter("varnode IS NOT NULL"))
    pick = lambda k: F.array_join(F.transform(F.array_sort(F.collect_set(F.when(F.col("k") == k, F.col("seq")))), lambda x: x.cast("string")), ",")
    return both.groupBy("func", "varnode").agg(pick("d").alias("defs"), pick("u").alias("uses"))


def lifetimes(ops: DataFrame) -> DataFrame:
    """func, varnode, born, dies, n_uses: the first definition (or -1) and the last use (or last definition)."""
    d = ops.filter("output IS NOT NULL").select("func", F.col("output").alias("varnode"), F.col("seq").alias("d"), F.lit(None).cast("long").alias("u"))
    u = ops.select("func", F.explode("inputs").alias("varnode"), F.lit(None).cast("long").alias("d"), F.col("seq").alias("u")).filter("varnode IS NOT NULL")
    per = d.unionByName(u).groupBy("func", "varnode").agg(F.min("d").alias("first"), F.max("u").alias("last"), F.max("d").alias("last_d"), F.count("u").alias("n_uses"))
    return per.select("func", "varnode", F.coalesce("first", F.lit(-1)).alias("born"), F.coalesce("last", "last_d").alias("dies"), "n_uses")


def usage_boost(life: DataFrame, register: Column, constant: Column) -> DataFrame:
    """A score by number of uses, more for registers, less for constants."""
    base = F.when(F.col("n_uses") >= 10, 0.3).when(F.col("n_uses") >= 5, 0.2).when(F.col("n_uses") >= 2, 0.1).otherwise(0.0)
    return life.withColumn("boost", F.greatest(base + F.when(register, 0.05).otherwise(0.0) - F.when(constant, 0.1).otherwise(0.0), F.lit(0.0)))


def ratio_class(ops: DataFrame) -> DataFrame:
    """func, class: by the parts of arithmetic, memory and branch operations, in that order of thresholds."""
    part = lambda k: F.count_if(F.col("kind") == k) / F.count(F.lit(1))
    per = ops.groupBy("func").agg(part("arith").alias("a"), part("mem").alias("m"), part("branch").alias("b"), F.count(F.lit(1)).alias("n"))
    return per.select("func", "n", F.when(F.col("a") >= 0.5, "computational").when(F.col("m") >= 0.5, "memory").when(F.col("b") >= 0.4, "control").otherwise("mixed").alias("class"))


def histogram(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, histogram: sorted value:count entries, and their SHA-256. Counts come first, so a common value costs one row a task."""
    n = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    text = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.col(value).cast("string"), F.col("n").cast("string")))), "|")
    return n.groupBy(group).agg(text.alias("histogram")).withColumn("digest", F.sha2("histogram", 256))


def struct_layout(accesses: DataFrame) -> DataFrame:
    """var, layout, size, aligned: the widest access of each offset, and the size rounded up to the widest field."""
    per = accesses.groupBy("var", "offset").agg(F.max("width").alias("width"))
    got = per.groupBy("var").agg(F.array_sort(F.collect_list(F.struct("offset", "width"))).alias("f"), F.max(F.col("offset") + F.col("width")).alias("size"), F.max("width").alias("wide"))
    layout = F.array_join(F.transform("f", lambda x: F.concat_ws(":", x["offset"].cast("string"), x["width"].cast("string"))), ",")
    return got.select("var", layout.alias("layout"), F.col("size").cast("long").alias("size"), (F.ceil(F.col("size") / F.col("wide")) * F.col("wide")).cast("long").alias("aligned"))


def stride(accesses: DataFrame, least: int = 3) -> DataFrame:
    """var, stride, n of variables whose sorted distinct offsets, three at least, lie at one distance."""
    w = Window.partitionBy("var").orderBy("offset")
    gaps = accesses.select("var", "offset").distinct().withColumn("gap", F.col("offset") - F.lag("offset").over(w))
    per = gaps.groupBy("var").agg(F.min("gap").alias("stride"), F.max("gap").alias("most"), F.count(F.lit(1)).alias("n"))
    return per.filter((F.col("n") >= least) & (F.col("stride") == F.col("most"))).select("var", "stride", "n")


def overlap_and_padding(fields: DataFrame) -> DataFrame:
    """var, overlaps, padding of fields(var, offset, width): pairs of fields that share bytes, and bytes between fields that none covers.

    Padding is gaps and islands; overlaps are counted from the number of fields that end after each field starts, in one pass.
    """
    f = fields.select("var", "offset", "width").distinct()
    w = Window.partitionBy("var").orderBy("offset", "width").rowsBetween(Window.unboundedPreceding, -1)
    stops = f.withColumn("before", F.max(F.col("offset") + F.col("width")).over(w)).withColumn("ends", F.collect_list(F.col("offset") + F.col("width")).over(w))
    gap = F.when(F.col("before").isNotNull(), F.greatest(F.col("offset") - F.col("before"), F.lit(0))).otherwise(0)
    hits = F.size(F.filter("ends", lambda e: e > F.col("offset")))
    return stops.groupBy("var").agg(F.sum(hits).cast("long").alias("overlaps"), F.sum(gap).cast("long").alias("padding"))


def cheapest_candidate(candidates: DataFrame) -> DataFrame:
    """var, family, candidate, cost: with one candidate per family and costs that add up, the best layout is each family's cheapest."""
    return candidates.groupBy("var", "family").agg(F.min(F.struct("cost", "candidate")).alias("b")).select("var", "family", "b.candidate", "b.cost")
