"""Signature tables: merging files, lookups by symbol, filters by platform, and conversions of keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def merge_signatures(entries: DataFrame) -> DataFrame:
    """entries(file, name, ...) with one row for each name: that of the first file in order that has it."""
    w = Window.partitionBy("name").orderBy("file")
    return entries.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def merge_report(entries: DataFrame) -> DataFrame:
    """file, entries, names, kept: rows of each file, its distinct names, and how many of them the merge takes from it."""
    per = entries.groupBy("file").agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("name").alias("names"))
    kept = entries.groupBy("name").agg(F.min("file").alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("kept"))
    return per.join(kept, "file", "left").select("file", "entries", "names", F.coalesce("kept", F.lit(0)).alias("kept"))


def unnamed(symbol: Column) -> Column:
    """Whether a disassembler made the name up."""
    return symbol.startswith("FUN_") | symbol.startswith("sub_") | symbol.startswith("thunk_")


def lookup_signatures(symbols: DataFrame, signatures: DataFrame, platform: str | None = None, categories: Sequence[str] | None = None) -> DataFrame:
    """symbols(symbol, ...) with what signatures(name, platform, category, ...) say of theirs; names that a disassembler made up aren't looked up.

    platform: signatures of others are left out, those of none hold everywhere. An equi-join: Spark sends the smaller side if it is small.
    """
    s = signatures
    if platform is not None:
        s = s.filter(F.col("platform").isNull() | (F.col("platform") == platform))
    if categories is not None:
        s = s.filter(F.col("category").isin(*categories))
    return symbols.filter(~unnamed(F.col("symbol"))).join(s, F.col("symbol") == F.col("name")).drop("name")


def by_name(capabilities: DataFrame, functions: DataFrame) -> DataFrame:
    """capabilities(address, ...) by the name of the function at the address instead; an address without one keeps itself."""
    f = functions.select(F.col("address").alias("__a"), F.col("name").alias("__n"))
    return capabilities.join(f, F.col("address") == F.col("__a"), "left").withColumn("name", F.coalesce("__n", F.col("address").cast("string"))).drop("__a", "__n", "address")


def best_targets(functions: DataFrame, n: int) -> DataFrame:
    """The n functions(id, size, callers, callees, strings) of highest interest, ties by id: the top-k is the feature."""
    score = F.ln(1 + F.col("size")) + 2 * F.ln(1 + F.col("callees")) + F.ln(1 + F.col("callers")) + 0.5 * F.col("strings")
    return functions.select("id", F.bround(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(n)


def enrich(rows: DataFrame, dictionary: DataFrame, key: str, default: str) -> DataFrame:
    """rows with `value` of dictionary(word, value), where the key is a word of it, else the default."""
    return rows.join(dictionary.select(F.col("word").alias("__w"), "value"), F.col(key) == F.col("__w"), "left").withColumn("value", F.coalesce("value", F.lit(default))).drop("__w")
