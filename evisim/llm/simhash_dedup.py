"""SimHash near-dedup with vantage-point trees over fingerprints.

A text's fingerprint is the bitwise majority of the hashes of its word shingles. Two fingerprints link when they differ in
`distance` bits or fewer, and groups are the connected components of links.

Search. Fingerprints are cut into blocks, and two that link agree in some of them. Up to 3 bits (`distance` below BLOCKS): of m
blocks m - distance agree, so fingerprints meet by every choice of so many blocks, and m grows with their number, so that a
value of a choice is shared by a bounded number of them however many there are (`blocks.choices`). Beyond: with BLOCKS blocks of 16
bits, one block differs in floor(distance / BLOCKS) bits at most, so each block has a vantage-point tree over its values: a node splits
them by their Hamming distance to a vantage value at the weighted median, and a search of that small radius prunes
a side by the triangle bound or, at a boundary, visits both. (A tree over all 64 bits alone would not do: distances gather around 32, a
search of radius 3 crosses most boundaries, and copies grow as the input to the power 1.7.)
Values are dealt to shards of about SHARD_KEYS. In a shard a vantage-point tree over all 64 bits prunes the pairs of
a value by the triangle bound, both sides at a boundary, and every pair that is left is compared. A shard returns no pairs: only a link from
each member to the smallest of its group there, which keeps the components and is linear in its rows.

Null, empty and white-space texts have fingerprint zero, which links like any other. Rows with null doc_id are fingerprinted
and linked; a component's id is its smallest doc_id that isn't null. Repeated rows come out as often as they came in, very long
texts are fingerprinted whole, an empty table gives an empty one. `near_groups` leaves extra columns out. `drop_near` goes by doc_id
and text: rows of one doc_id with other texts, and rows without one, are judged each by itself, rows equal in both stay once, and
extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from evisim.llm.blocks import choices, signed
from evisim.llm.components import components
from evisim.llm.exact_dedup import once_each, without
from evisim.llm.staging import staged
from evisim.llm.words import text_of

BLOCKS = 4
BITS = 16
DISTANCE = 3
SEED = 42
SHINGLE = 3
#: Fingerprints of a shard, if a block's value isn't more common by itself.
SHARD_KEYS = 2048
#: In a shard, sets of this many fingerprints are compared directly.
BUCKET = 512


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Of a whole text: A-Z lower-cased, words split at ASCII white space, shingles counted as often as they occur."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), seed)
    hashes = np.fromiter((digest(b" ".join(s), seed) for s in zip(*(words[i:] for i in range(shingle)), strict=False)), np.uint64, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, digest: bool = False) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), and the text's SHA-256 if asked for."""
    more = [F.unhex(F.sha2(text_of(), 256)).alias("digest")] if digest else []

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fps = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *batch.schema.names[2:]])
            pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long"), "text", *more).mapInArrow(run, "doc_id long, fp long" + ", digest binary" * digest)


def block_tree(values: np.ndarray, weights: np.ndarray, radius: int, most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The shard of each value and, for each shard, which values visit it besides its members."""
    home, visits, shards = np.zeros(len(values), np.int32), [], 0
    stack = [(np.arange(len(values)), np.zeros(0, np.int64))]
    while stack:
        own, near = stack.pop()
        if weights[own].sum() <= most or len(own) < 2:
            home[own] = shards
            visits.append(near)
            shards += 1
            continue
        vantage = values[own[0]]
        d = np.bitwise_count(values[own] ^ vantage).astype(np.int64)
        order = np.argsort(d, kind="stable")
        run = np.cumsum(weights[own][order])
        mid = int(d[order[np.searchsorted(run, run[-1] / 2)]])
        mid = min(mid, int(d.max()) - 1)  # the far side isn't empty: the vantage value itself is at 0
        e = np.bitwise_count(values[near] ^ vantage).astype(np.int64)
        inner, outer = own[d <= mid], own[d > mid]
        stack.append((inner, np.concatenate([near[e <= mid + radius], own[(d > mid) & (d <= mid + radius)]])))
        stack.append((outer, np.concatenate([near[e > mid - radius], own[(d <= mid) & (d > mid - radius)]])))
    return home, visits


def _block(fp: np.ndarray, b: int) -> np.ndarray:
    return ((fp.view(np.uint64) >> np.uint64(BITS * b)) & np.uint64(0xFFFF)).astype(np.int64)


def _links(fps: np.ndarray, own: np.ndarray, distance: int) -> np.ndarray:
    """The place of each fingerprint's group in a shard. own: members; pairs of two visitors meet in another shard."""
    label = np.arange(len(fps))

    def join(rows: np.ndarray, cols: np.ndarray) -> None:
        for k in range(0, len(rows), 256):
            part = rows[k : k + 256]
            near = np.bitwise_count(fps[part][:, None] ^ fps[cols][None, :]) <= distance
            for i in np.flatnonzero(near.any(axis=1)):
                met = cols[near[i]]
                found = np.unique(np.append(label[met], label[part[i]]))
                if len(found) > 1:
                    label[np.isin(label, found[1:])] = found[0]

    # (a, b): all pairs of one of a and one of b; b None: all pairs in a.
    stack: list[tuple[np.ndarray, np.ndarray | None]] = [(np.flatnonzero(own), None), (np.flatnonzero(own), np.flatnonzero(~own))]
    while stack:
        a, b = stack.pop()
        if not len(a) or (b is not None and not len(b)):
            continue
        if len(a) * len(a if b is None else b) <= BUCKET * BUCKET:
            join(a, a if b is None else b)
            continue
        da = np.bitwise_count(fps[a] ^ fps[a[0]]).astype(np.int64)
        mid = int(np.median(da))
        if mid >= da.max():
            mid = int(da.max()) - 1
        if mid < 0:  # all of a at one place
            join(a[:1] if b is None else a, a if b is None else b)
            continue
        in_a, out_a = a[da <= mid], a[da > mid]
        if b is None:
            parts = [(in_a, None), (out_a, None), (a[(da <= mid) & (da > mid - distance)], a[(da > mid) & (da <= mid + distance)])]
        else:
            db = np.bitwise_count(fps[b] ^ fps[a[0]]).astype(np.int64)
            parts = [(in_a, b[db <= mid + distance]), (out_a, b[db > mid - distance])]
        for p, q in parts:
            if q is not None and len(p) * len(q) >= len(a) * len(a if b is None else b) * 0.9:
                join(p, q)  # the bound prunes nothing here
            else:
                stack.append((p, q))
    return label


def links(nodes: DataFrame, distance: int = DISTANCE, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """a, b: links that leave the components of all links. nodes(fp), distinct, a written table."""
    return _links_by_choices(nodes, distance, shard_keys) if distance < BLOCKS else _links_by_trees(nodes, distance, shard_keys)


def _links_by_choices(nodes: DataFrame, distance: int, shard_keys: int) -> DataFrame:
    n = nodes.count()
    masks = choices(n, distance)
    shards = max(1, -(-n * len(masks) // shard_keys))
    places = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("v")) for k, m in enumerate(masks)])
    rows = nodes.select("fp", F.explode(places).alias("p")).select(F.pmod(F.xxhash64("p.k", "p.v"), F.lit(shards)).alias("shard"), "p.k", "p.v", "fp")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k", "v", "fp"])
        k, v, fps = (pdf[c].to_numpy() for c in ("k", "v", "fp"))
        cuts = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (v[1:] != v[:-1])]))
        label = np.arange(len(fps))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(fps)], strict=True):
            if b - a > 1:
                label[a:b] = a + _links(fps[a:b].view(np.uint64), np.ones(b - a, bool), distance)
        moved = label != np.arange(len(label))
        return pd.DataFrame({"a": fps[label[moved]], "b": fps[moved]})

    return rows.groupBy("shard").applyInPandas(search, "a long, b long")


def _links_by_trees(nodes: DataFrame, distance: int, shard_keys: int) -> DataFrame:
    radius = distance // BLOCKS
    blocks = F.array(*[F.shiftrightunsigned("fp", BITS * b).bitwiseAND(F.lit(0xFFFF)) for b in range(BLOCKS)])
    counted = nodes.select(F.posexplode(blocks).alias("b", "v")).groupBy("b", "v").count().collect()  # 4 x 65,536 rows at most
    homes, routes, first = np.zeros((BLOCKS, 1 << BITS), np.int64), [], 0
    for b in range(BLOCKS):
        rows = sorted((r["v"], r["count"]) for r in counted if r["b"] == b)
        values, weights = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        home, visits = block_tree(values, weights, radius, shard_keys)
        homes[b, values] = first + home
        visitors: dict[int, list[int]] = {}
        for s, near in enumerate(visits):
            for v in values[near]:
                visitors.setdefault(int(v), []).append(first + s)
        routes.append(visitors)
        first += len(visits)

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for b in range(BLOCKS):
                v = _block(fp, b)
                yield pa.RecordBatch.from_arrays([pa.array(homes[b][v]), pa.array(fp), pa.array(np.ones(len(fp), bool))], names=["shard", "fp", "own"])
                if routes[b]:
                    more = [(s, f) for x, f in zip(v.tolist(), fp.tolist(), strict=True) for s in routes[b].get(x, ())]
                    yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in more], pa.int64()), pa.array([m[1] for m in more], pa.int64()), pa.array(np.zeros(len(more), bool))], names=["shard", "fp", "own"])

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("fp")
        fps = pdf["fp"].to_numpy()
        label = _links(fps.view(np.uint64), pdf["own"].to_numpy(), distance)
        moved = label != np.arange(len(label))
        return pd.DataFrame({"a": fps[label[moved]], "b": fps[moved]})

    dealt = nodes.select("fp").mapInArrow(deal, "shard long, fp long, own boolean")
    return dealt.groupBy("shard").applyInPandas(search, "a long, b long")


def _grouped(fps: DataFrame, distance: int) -> DataFrame:
    """fps, a written table, with component_id and root, which tells groups apart."""
    nodes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "near-nodes")
    found = components(links(nodes, distance), "near-links")
    rooted = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    rooted = staged(rooted, "near-rooted")
    lowest = staged(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "near-lowest").withColumnRenamed("root", "r")
    ids = staged(rooted.join(lowest, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id", "root"), "near-ids")
    return fps.join(ids, F.col("fp") == F.col("f")).drop("f")


def near_groups(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp, component_id of every row of docs."""
    return _grouped(staged(fingerprints(docs, shingle, seed), "near-fps"), distance).select("doc_id", "fp", "component_id")


def fingerprint_hex(column: str = "fp"):
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def drop_near(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """docs with one row of each group: the one with the smallest doc_id, null last, then the smallest digest of the text."""
    groups = _grouped(staged(fingerprints(docs, digest=True), "near-fps"), distance)
    rows = staged(groups.groupBy("root", "doc_id", "digest").agg(F.count(F.lit(1)).alias("n")), "near-rows")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
    firsts = staged(rows.groupBy("root").agg(F.min(place).alias("first")), "near-firsts").withColumnRenamed("root", "r")
    judged = rows.join(firsts, F.col("root") == F.col("r")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest")))
    judged = staged(judged.filter("n > 1 OR NOT kept").select("doc_id", "digest", "kept"), "near-lost")
    return once_each(without(docs, judged.filter("NOT kept").select("doc_id", "digest")), judged.filter("kept").select("doc_id", "digest"))
