"""Similarity of vectors: best match, margin rule against a template bank, hash prefilter, banded MinHash.

Rows that have to be compared meet in blocks, which are compared as matrices; of each block a row keeps as many as can count in the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from evisim.operators.matching import best_per_target
from evisim.tables import written

#: Rows of either side in a block at most, about.
BLOCK = 16_384
#: Scores of a block that are held at once.
SCORES = 4_000_000


def unit(c: Column) -> Column:
    """The vector over its length, as doubles; null for a zero vector."""
    d = F.transform(c, lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, v: s + v * v))
    return F.when(norm > 0, F.transform(d, lambda v: v / norm))


def _best_of(scores: np.ndarray, least: float, k: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of scores of at least that, k each at most: the greatest, of equal ones the first. scores is used up."""
    if k is None:
        return np.nonzero(scores >= least)
    rows, cols, every = [], [], np.arange(len(scores))
    for _ in range(min(k, scores.shape[1])):
        top = scores.argmax(axis=1)
        enough = scores[every, top] >= least
        if not enough.any():
            break
        rows.append(every[enough])
        cols.append(top[enough])
        scores[every, top] = -np.inf if scores.dtype.kind == "f" else -1
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def met_in_blocks(a: DataFrame, b: DataFrame, compare: Callable[[np.ndarray, np.ndarray], np.ndarray], least: float, k: int | None, keyed: bool, itself: bool = False) -> DataFrame:
    """r, t, score of a(r, x, h) and b(t, x, h): rows of equal h (all, if not keyed) with vectors of one length, by compare(matrix, matrix). k: a row's best of each block, ties by t; None: all.

    A key with over BLOCK rows is cut into blocks on either side, each of which meets each of the other; rare keys share a block. itself: r may meet an equal t.
    """
    schema = StructType([StructField("r", a.schema["r"].dataType), StructField("t", b.schema["t"].dataType), StructField("score", DoubleType())])
    a, b = a.filter("r IS NOT NULL AND x IS NOT NULL"), b.filter("t IS NOT NULL AND x IS NOT NULL")
    if keyed:
        n = a.groupBy("h").agg(F.count(F.lit(1)).alias("na")).join(b.groupBy("h").agg(F.count(F.lit(1)).alias("nb")), "h")
        n = written(n.select(F.col("h").alias("k"), F.ceil(F.col("na") / BLOCK).alias("ma"), F.ceil(F.col("nb") / BLOCK).alias("mb"), "na", "nb"))
        rows = n.agg(F.sum("na") + F.sum("nb")).collect()[0][0] or 0
        place = F.pmod(F.xxhash64("h"), F.lit(max(1, rows // BLOCK)))
        a, b = a.join(n, F.col("h") == F.col("k")), b.join(n, F.col("h") == F.col("k"))
    else:
        ma, mb = (F.lit(max(1, -(-x.count() // BLOCK))) for x in (a, b))
        place = F.lit(0).cast("long")
        a, b = (x.withColumns({"ma": ma, "mb": mb, "h": F.lit(0)}) for x in (a, b))
    cut = lambda c, m: F.pmod(F.xxhash64(c), F.col(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), (F.col(m) - 1).cast("int")))
    a = a.withColumn("i", cut("r", "ma")).withColumn("j", each("mb")).select(place.alias("place"), "i", "j", "r", "x", "h")
    b = b.withColumn("j", cut("t", "mb")).withColumn("i", each("ma")).select(place.alias("place"), "i", "j", "t", "x", "h")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sides = []
        codes = pa.chunked_array([*left["h"].chunks, *right["h"].chunks], left["h"].type).combine_chunks().dictionary_encode().indices.to_numpy()
        for side, name, h in ((left, "r", codes[: len(left)]), (right, "t", codes[len(left) :])):
            x = side["x"].combine_chunks()
            size = pc.list_value_length(x).to_numpy(zero_copy_only=False)
            ids, start = side[name].to_numpy(), np.concatenate([[0], np.cumsum(size)])[:-1]
            order = np.lexsort((ids, size, h))
            sides.append((ids[order], x.flatten().to_numpy(zero_copy_only=False), start[order], size[order], h[order]))
        (r, xa, sa, na, ha), (t, xb, sb, nb, hb) = sides
        kinds = lambda h, n: h.astype(np.int64) << 32 | n.astype(np.int64)
        ka, kb = kinds(ha, na), kinds(hb, nb)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for kind in np.intersect1d(ka, kb):
            ia, ib = (slice(*np.searchsorted(z, [kind, kind + 1])) for z in (ka, kb))
            length = np.arange(int(kind) & 0xFFFFFFFF)
            x, y, ids = xa[sa[ia, None] + length], xb[sb[ib, None] + length], t[ib]
            step = max(1, SCORES // len(y))
            for at in range(0, len(x), step):
                mine = r[ia][at : at + step]
                scores = compare(x[at : at + step], y)
                if not itself:
                    low, high = np.searchsorted(ids, mine, "left"), np.searchsorted(ids, mine, "right")
                    for m in np.flatnonzero(high > low):
                        scores[m, low[m] : high[m]] = -np.inf if scores.dtype.kind == "f" else -1
                kept = scores.copy() if k is not None else scores
                rows, cols = _best_of(kept, least, k)
                found.append((mine[rows], ids[cols], scores[rows, cols].astype(np.float64)))
        out = [np.concatenate(z) if found else [] for z in (zip(*found, strict=True) if found else ((), (), ()))]
        return pa.Table.from_arrays([pa.array(out[0], left["r"].type), pa.array(out[1], right["t"].type), pa.array(out[2], pa.float64())], names=["r", "t", "score"])

    on = ["place", "i", "j"]
    return a.groupBy(*on).cogroup(b.groupBy(*on)).applyInArrow(run, schema)


def _dots(digits: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    return lambda x, y: np.round(x @ y.T, digits)


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    """The k best t of each r over all blocks, with rn."""
    w = Window.partitionBy("r").orderBy(F.desc("score"), "t")
    return pairs.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def cosine_pairs(queries: DataFrame, templates: DataFrame, least: float, digits: int = 6, k: int | None = None) -> DataFrame:
    """r, t, score of queries(id, v) against every row of a template bank(id, v); k: only the best so many of a query, ties by t."""
    a = queries.select(F.col("id").alias("r"), unit(F.col("v")).alias("x"))
    b = templates.select(F.col("id").alias("t"), unit(F.col("v")).alias("x"))
    pairs = met_in_blocks(a, b, _dots(digits), least, k, keyed=False)
    return pairs if k is None else _ranked(pairs, k).drop("rn")


def cosine_best(queries: DataFrame, templates: DataFrame, least: float = 0.85, factor: float = 0.88, cap: float = 0.95) -> DataFrame:
    """r, t, score, confidence, one-to-one."""
    best = best_per_target(cosine_pairs(queries, templates, least, k=1))
    return best.select("r", "t", "score", F.bround(F.least(F.col("score") * factor, F.lit(cap)), 6).alias("confidence"))


def margin_topk(pairs: DataFrame, margin: float = 0.10, k: int = 3) -> DataFrame:
    """r, t, score, rn of the top k; none at all where the first is ahead of the second by less than the margin."""
    w = Window.partitionBy("r").orderBy(F.desc("score"), "t")
    ranked = pairs.withColumn("rn", F.row_number().over(w)).withColumn("next", F.lead("score").over(w))
    first = F.max(F.when(F.col("rn") == 1, F.bround(F.col("score") - F.col("next"), 6))).over(Window.partitionBy("r"))
    return ranked.withColumn("gap", first).filter((F.col("rn") <= k) & (F.col("gap").isNull() | (F.col("gap") >= margin))).select("r", "t", "score", "rn")


def prefilter_match(queries: DataFrame, templates: DataFrame, equal: float = 0.90, otherwise: float = 0.95) -> DataFrame:
    """r, t, score, confidence of (id, v, hash): equal hashes first, then what is left against the bank."""
    a = queries.select(F.col("id").alias("r"), unit(F.col("v")).alias("x"), F.col("hash").alias("h"))
    b = templates.select(F.col("id").alias("t"), unit(F.col("v")).alias("x"), F.col("hash").alias("h"))
    same = met_in_blocks(a, b, _dots(6), equal, 1, keyed=True)
    first = written(_ranked(same, 1).select("r", "t", "score", F.lit(0.85).alias("confidence")))
    rest = queries.join(first.select(F.col("r").alias("id")), "id", "left_anti")
    other = cosine_pairs(rest, templates, otherwise, k=1).select("r", "t", "score", F.lit(0.70).alias("confidence"))
    return first.unionByName(other)


def minhash_signatures(sets: DataFrame, size: int = 16) -> DataFrame:
    """id, sig of sets(id, tokens): the smallest of each of `size` seeded 28-bit MD5 hashes over a set of strings, null if it is empty. A token is hashed once a batch."""

    def hashed(token: str) -> list[int]:
        return [int(hashlib.md5(f"{i}:{token}".encode(), usedforsecurity=False).hexdigest()[:7], 16) for i in range(size)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lists = batch.column(1)
            tokens = lists.flatten()
            owner = pc.list_parent_indices(lists).to_numpy()
            given = pc.is_valid(tokens).to_numpy(zero_copy_only=False)
            coded = tokens.dictionary_encode()
            table = np.array([hashed(x) for x in coded.dictionary.to_pylist()], np.int32).reshape(-1, size)
            owner, codes = owner[given], coded.indices.drop_null().to_numpy()
            least = np.full((len(lists), size), -1, np.int32)
            if len(owner):
                begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                for k in range(size):
                    least[owner[begins], k] = np.minimum.reduceat(table[codes, k], begins)
            values = pa.array(least.ravel(), mask=least.ravel() < 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * size), values)], names=["id", "sig"])

    schema = StructType([sets.schema["id"], StructField("sig", ArrayType(IntegerType()))])
    return sets.select("id", F.col("tokens").cast("array<string>")).mapInArrow(run, schema)


def _agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many values of signatures are equal; -1 stands for none and is equal to nothing."""
    out = np.zeros((len(x), len(y)), np.int16)
    for k in range(x.shape[1]):
        out += x[:, k, None] == np.where(y[:, k] < 0, -2, y[:, k])[None]
    return out


def lsh_candidates(sets: DataFrame, queries: DataFrame, size: int = 16, rows: int = 4, k: int = 5) -> DataFrame:
    """r, t, agreement: sets(id, tokens) that share a band of MinHash values with a query, by the part of equal values; top k.

    Equal token sets, and then equal signatures, are compared once. Of the sets of one signature only the k + 1 with the smallest ids can be among the
    top k of a query, which may be one of them.
    """

    def signed(df: DataFrame) -> DataFrame:
        """id, sig, each distinct list of tokens worked on once."""
        given = written(df.select("id", "tokens", F.xxhash64("tokens").alias("hash")))
        distinct = given.select("hash", "tokens").distinct().select(F.struct("hash", "tokens").alias("id"), "tokens")
        sig = minhash_signatures(distinct, size).select(F.col("id.hash").alias("h"), F.col("id.tokens").alias("w"), "sig")
        return given.join(sig, (F.col("hash") == F.col("h")) & F.col("tokens").eqNullSafe(F.col("w"))).select("id", "sig")

    def banded(df: DataFrame, name: str) -> DataFrame:
        bands = F.array(*[F.concat_ws(",", F.lit(i), *[F.col("sig")[i * rows + j] for j in range(rows)]) for i in range(size // rows)])
        return df.select(F.col("id").alias(name), F.transform("sig", lambda v: F.coalesce(v, F.lit(-1))).alias("x"), F.explode(bands).alias("h"))

    first = Window.partitionBy("sig").orderBy("id")
    few = written(signed(sets).distinct().withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1).drop("n"))
    asked = written(signed(queries).distinct())
    classes = written(asked.groupBy("sig").agg(F.min("id").alias("id")))
    met = met_in_blocks(banded(classes, "r"), banded(few, "t"), _agreeing, 0, k + 1, keyed=True, itself=True)
    best = written(_ranked(met.distinct(), k + 1).select(F.col("r").alias("class"), "t", "score"))
    of = asked.join(classes.select("sig", F.col("id").alias("class")), "sig").select(F.col("id").alias("r"), "class")
    top = _ranked(of.join(best, "class").filter("r <> t").select("r", "t", "score"), k)
    return top.select("r", "t", (F.col("score") / size).alias("agreement"))
