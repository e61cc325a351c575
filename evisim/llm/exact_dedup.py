"""Exact dedup by a minimal perfect hash over historical distinct digests.

`build_index` maps every distinct digest of the history to a slot of its shard. A shard is one row: the bit levels of a
minimal perfect hash, and by slot the full digest, the winner's locator (its doc_id) and the rows behind it. `lookup` finds
the slot of a digest and compares all of its bytes with the slot's digest, so a digest that isn't a member is never taken
for one. `assign` gives members the winner of their slot and groups nonmembers among themselves. A table by itself is deduped so
(`winners`): the rows up to the middle doc_id are the history, the later ones are looked up, a slot's group grows by the members found, and
nonmembers form groups of their own.

Shards hold about SHARD_KEYS keys and are addressed by the digest's leading bits, which are even by nature, so neither side
is skewed: only distinct digests are looked up, and copies meet again in a join that Spark can split.

Null texts count as empty. The largest doc_id of equal texts stays; null doc_ids lose to any other. Rows with the winner's
doc_id count as that document and are all marked kept; `drop_repeats` leaves one of them. It removes rows by doc_id and text, so
rows of one doc_id with different texts are judged each by itself. Rows without a doc_id are documents like others: of texts that
only such rows have, one stays. Extra columns pass through, texts of any length are read whole, an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from evisim.llm.staging import staged
from evisim.llm.words import text_of

SHARD_KEYS = 2048
GAMMA = 1.5
LEVELS = 48
#: A table of rows to leave out, of about 50 bytes each, is sent to all tasks up to this many.
SEND_ROWS = 200_000

INDEX = "shard long, n long, levels array<binary>, widths array<long>, rest array<binary>, digests binary, winners array<long>, sizes array<long>"


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit finaliser, another one for each level."""
    x = keys + np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(digests: np.ndarray) -> np.ndarray:
    """64 bits of each digest that the shard's number doesn't use."""
    return np.ascontiguousarray(digests[:, 8:16]).view("<u8").ravel()


def build_levels(digests: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays by level, and the rows that no level separates (equal in all key bits).

    On each level a key alone on its bit takes it; keys that meet go on to the next level.
    """
    levels, left, keys = [], np.arange(len(digests)), _keys(digests)
    for level in range(LEVELS):
        if not len(left):
            break
        width = max(8, int(GAMMA * len(left)))
        at = (_mixed(keys[left], level) % np.uint64(width)).astype(np.int64)
        alone = np.bincount(at, minlength=width) == 1
        levels.append(alone)
        left = left[~alone[at]]
    return levels, left


def slots_of(digests: np.ndarray, levels: list[np.ndarray], rest: list[bytes]) -> np.ndarray:
    """The slot that each digest would have; -1 where no level takes it."""
    slots, left, base, keys = np.full(len(digests), -1, np.int64), np.arange(len(digests)), 0, _keys(digests)
    for level, bits in enumerate(levels):
        if not len(left):
            break
        at = (_mixed(keys[left], level) % np.uint64(len(bits))).astype(np.int64)
        hit = bits[at]
        slots[left[hit]] = base + (np.cumsum(bits) - 1)[at[hit]]
        left, base = left[~hit], base + int(bits.sum())
    if rest and len(left):
        places = {d: base + i for i, d in enumerate(rest)}
        slots[left] = [places.get(bytes(d), -1) for d in digests[left]]
    return slots


def _matrix(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    digests = _matrix(pdf["digest"])
    levels, left = build_levels(digests)
    rest = [bytes(d) for d in digests[left]]
    order = np.argsort(slots_of(digests, levels, rest))
    row = {"shard": pdf["shard"].iloc[0], "n": len(pdf), "levels": [np.packbits(x).tobytes() for x in levels], "widths": [len(x) for x in levels], "rest": rest, "digests": digests[order].tobytes()}
    winners = [None if pd.isna(x) else int(x) for x in pdf["winner"].iloc[order]]
    return pd.DataFrame([row | {"winners": winners, "sizes": pdf["size"].to_numpy()[order]}])


def _lookup(probes: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame({"digest": probes["digest"], "winner": pd.Series(pd.NA, probes.index, "Int64"), "size": pd.Series(pd.NA, probes.index, "Int64"), "member": False})
    if not len(probes) or not len(index):
        return out
    row, digests = index.iloc[0], _matrix(probes["digest"])
    levels = [np.unpackbits(np.frombuffer(b, np.uint8), count=w).astype(bool) for b, w in zip(row["levels"], row["widths"], strict=True)]
    slots = slots_of(digests, levels, [bytes(x) for x in row["rest"]])
    held = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
    member = (slots >= 0) & (held[np.maximum(slots, 0)] == digests).all(axis=1)
    at = slots[member]
    out.loc[member, "winner"] = pd.array([row["winners"][i] for i in at], "Int64")
    out.loc[member, "size"] = pd.array(np.asarray(row["sizes"])[at], "Int64")
    out["member"] = member
    return out


def digests_of(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of the whole text."""
    return docs.select("doc_id", F.unhex(F.sha2(text_of(), 256)).alias("digest"))


def distinct_digests(digests: DataFrame) -> DataFrame:
    """digest, winner, size, and how many rows carry the winner's doc_id; copies are counted before they move."""
    pairs = digests.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.sum("n").alias("size"), F.max_by("n", "doc_id").alias("winner_rows"))


def _with_shard(df: DataFrame, shards: int) -> DataFrame:
    lead = F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long")
    return df.withColumn("shard", lead % F.lit(shards))


def build_index(history: DataFrame, n_keys: int | None = None) -> tuple[DataFrame, int]:
    """The index of history(digest, winner, size), distinct by digest, as a written table, and its number of shards."""
    shards = max(1, -(-(history.count() if n_keys is None else n_keys) // SHARD_KEYS))
    rows = _with_shard(history.select("digest", "winner", "size"), shards)
    return staged(rows.groupBy("shard").applyInPandas(_build, INDEX), "mph-index"), shards


def lookup(probes: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """digest, winner, size, member of probes(digest), distinct."""
    left = _with_shard(probes.select("digest"), shards)
    return left.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(_lookup, "digest binary, winner long, size long, member boolean")


def assign(digests: DataFrame, index: DataFrame, shards: int, distinct: DataFrame | None = None) -> DataFrame:
    """digest, winner, size, member of every distinct digest: the slot's for members, their own group's for the others."""
    own = distinct_digests(digests) if distinct is None else distinct
    found = lookup(own, index, shards)
    other = own.select(F.col("digest").alias("d2"), F.col("winner").alias("w2"), F.col("size").alias("s2"))
    merged = found.join(other, F.col("digest") == F.col("d2"))
    pick = lambda a, b: F.when(F.col("member"), F.col(a)).otherwise(F.col(b))
    return merged.select("digest", pick("winner", "w2").alias("winner"), pick("size", "s2").alias("size"), "member")


def winners(digests: DataFrame) -> DataFrame:
    """digest, winner, size, winner_rows (rows with the winner's doc_id) of every distinct digest of digests(doc_id, digest), a written table."""
    low, high = digests.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = 0 if low is None else (low + high) // 2
    old = staged(distinct_digests(digests.filter(F.col("doc_id") <= middle)), "dedup-history")
    new = staged(distinct_digests(digests.filter(~F.coalesce(F.col("doc_id") <= middle, F.lit(False)))), "dedup-later")
    index, shards = build_index(old)
    found = lookup(new, index, shards).select(F.col("digest").alias("d"), F.col("winner").alias("w"), F.col("size").alias("s"), "member")
    judged = staged(new.join(found, F.col("digest") == F.col("d")).drop("d"), "dedup-judged")
    # Later rows have larger doc_ids, or none: then the slot's winner stays.
    grown = judged.select("digest", F.coalesce("winner", "w").alias("winner"), (F.col("size") + F.coalesce("s", F.lit(0))).alias("size"), F.when(F.col("winner").isNull() & F.col("member"), F.lit(None)).otherwise(F.col("winner_rows")).alias("winner_rows"), F.col("winner").isNull().alias("old"))
    members = judged.filter("member").select(F.col("digest").alias("d"))
    untouched = old.join(members, F.col("digest") == F.col("d"), "left_anti")
    rows = old.select(F.col("digest").alias("d"), F.col("winner_rows").alias("r"))
    kept = grown.filter("old").join(rows, F.col("digest") == F.col("d"), "left").select("digest", "winner", "size", F.coalesce("r", "winner_rows").alias("winner_rows"))
    columns = ["digest", "winner", "size", "winner_rows"]
    return staged(untouched.select(columns).unionByName(grown.filter("NOT old").select(columns)).unionByName(kept), "dedup-winners")


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, digest, keep_id, group_size, kept of every row of docs."""
    digests = staged(digests_of(docs), "dedup-digests")
    best = winners(digests).select(F.col("digest").alias("d"), "winner", "size")
    joined = digests.join(best, F.col("digest") == F.col("d"))
    return joined.select("doc_id", "digest", F.col("winner").alias("keep_id"), F.col("size").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("winner")).alias("kept"))


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id and text's digest are in rows(doc_id, digest), a written table: sent if its rows are few, else both are shuffled."""
    gone = rows.select(F.col("doc_id").alias("__gone"), F.col("digest").alias("__d"))
    if rows.limit(SEND_ROWS + 1).count() <= SEND_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("__gone")) & (F.unhex(F.sha2(text_of(), 256)) == F.col("__d")), "left_anti")


def drop_repeats(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text another kept row has; one row stays of those that share doc_id and text."""
    digests = staged(digests_of(docs), "dedup-digests")
    best = winners(digests)
    own = best.select(F.col("digest").alias("d"), "winner")
    lost = digests.join(own, (F.col("digest") == F.col("d")) & ~F.col("doc_id").eqNullSafe(F.col("winner"))).select("doc_id", "digest").distinct()
    kept = without(docs, staged(lost, "dedup-lost"))
    # Without any doc_id but null there is no winner's row count: these digests' sizes say how often they come.
    rows = F.coalesce("winner_rows", F.when(F.col("winner").isNull(), F.col("size")))
    return once_each(kept, staged(best.filter(rows > 1).select(F.col("winner").alias("doc_id"), "digest"), "dedup-twice"))


def once_each(docs: DataFrame, twice: DataFrame) -> DataFrame:
    """docs with one row for each of twice(doc_id, digest), a written table; other rows as they are."""
    if twice.isEmpty():
        return docs
    ids = twice.select(F.col("doc_id").alias("__twice"), F.col("digest").alias("__d"))
    marked = docs.withColumn("__digest", F.unhex(F.sha2(text_of(), 256)))
    once = marked.join(ids, F.col("doc_id").eqNullSafe(F.col("__twice")) & (F.col("__digest") == F.col("__d")), "left_semi").dropDuplicates(["doc_id", "__digest"])
    return without(docs, twice).unionByName(once.drop("__digest"))


def batches(frames: Iterator[DataFrame]) -> Iterator[tuple[DataFrame, DataFrame]]:
    """For each batch of documents in turn, what is new in it, after dedup against all batches before: (digest, winner, size) rows and the index used."""
    history: DataFrame | None = None
    for docs in frames:
        own = staged(distinct_digests(digests_of(docs)), "dedup-batch")
        if history is None:
            history = new = own.select("digest", "winner", "size")
            index, _ = build_index(history)
        else:
            index, shards = build_index(history)
            new = staged(lookup(own, index, shards).filter("NOT member").select("digest").join(own, "digest").select("digest", "winner", "size"), "dedup-new")
            history = staged(history.unionByName(new), "dedup-history")
        yield new, index
