"""Packing of tokenised documents into sequences by vector best fit.

A document's ids are cut into pieces only if they exceed a sequence. A piece needs tokens, a place among the sequence's
documents, and attention cost (its length squared); a sequence has a capacity of each. Pieces go by falling length; of the open
sequences with room in every dimension the one is taken that leaves the smallest weighted residual norm ("norm") or has
the largest weighted dot product of residual and need ("dot"), the oldest of equals, else a new one is opened. A piece whose
attention cost exceeds the capacity by itself has a sequence of its own; one with too many tokens is an error.

Pieces are dealt by a hash to groups of about GROUP, each packed by itself: a group leaves no more than its last sequences
partly filled, and any number of groups run at once. Ids don't move: tokenising keeps their place, length and CRC, and
`sequence_ids` joins them on where the ids themselves are wanted.

Null and empty texts are the end-of-document id alone, texts of any length are cut, pieces of equal length go by their order in
the table, repeated rows are packed as often as they come, and an empty table gives no pieces. Extra columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from evisim.llm.staging import staged

CAPACITY = 4096
END = 1
GROUP = 8192
#: Documents and attention cost (as a part of the square of the tokens) of a sequence, and weights of tokens, documents, attention.
DOCUMENTS, ATTENTION, WEIGHTS = 64, 0.9, (1.0, 1.0, 1.0)
#: Words that a worker remembers; at that number it forgets all.
WORDS = 500_000
#: Bytes of text, more or less, that are split and gathered at once.
SLICE = 2_500_000
#: A chunk of letters that normalising leaves alone but for case, with one mark after it at most.
PLAIN = r"^[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+[.,!?;:]?$"
MARKS = ".,!?;:"


class Encoder:
    """Texts to ids, equal to the tokenizer's encode(text, add_special_tokens=False).

    For the lower-case word vocabulary, which drops white space: no token spans it, so a text's ids are those of its chunks
    between ASCII white space. A plain chunk is a word and perhaps a mark, as the tokenizer's own pattern splits it; a word
    is encoded once while its worker remembers it. Any other chunk goes through the tokenizer. Splitting, telling chunks
    apart and putting ids together run over arrays, so the interpreter sees distinct words only.
    """

    def __init__(self, tokenizer_path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model = self.tokenizer.model
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level BPE writes other bytes as code points from 256 on
        others = (b for b in range(256) if b not in set(printable))
        self.byte = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.words: dict[str, bytes] = {}

    def _known(self, words: list[str]) -> list[bytes]:
        known = self.words
        if len(known) > WORDS:
            known = self.words = {w: known[w] for w in words if w in known}
        tokenize, byte = self.model.tokenize, self.byte.__getitem__
        for w in words:
            if w not in known:
                known[w] = np.array([t.id for t in tokenize("".join(map(byte, w.encode())))], "<u4").tobytes()
        return [known[w] for w in words]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts one after the other, and the number of ids of each text."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        ends = lists.offsets.to_numpy()
        found = lists.flatten().dictionary_encode()
        chunks, at = found.dictionary, found.indices.to_numpy(zero_copy_only=False)
        plain = pc.match_substring_regex(chunks, PLAIN)
        is_plain = plain.to_numpy(zero_copy_only=False)
        own = chunks.filter(plain)
        stems = pc.utf8_rtrim(own, characters=MARKS)
        marked = pc.greater(pc.utf8_length(own), pc.utf8_length(stems)).to_numpy(zero_copy_only=False)
        words = pc.utf8_lower(stems).dictionary_encode()
        atoms = self._known(words.dictionary.to_pylist())
        # A chunk is two atoms: a word or an odd chunk, then a mark or nothing.
        first, second = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        first[is_plain] = words.indices.to_numpy(zero_copy_only=False)
        odd = np.flatnonzero(~is_plain)
        first[odd] = len(atoms) + np.arange(len(odd))
        for e in self.tokenizer.encode_batch(chunks.filter(pc.invert(plain)).to_pylist(), add_special_tokens=False) if len(odd) else ():
            atoms.append(np.array(e.ids, "<u4").tobytes())
        marks = self._known(list(MARKS))
        ends_in = pc.utf8_slice_codeunits(own, -1, None).to_numpy(zero_copy_only=False)
        places = {m: len(atoms) + i for i, m in enumerate(MARKS)}
        atoms += [*marks, b""]
        nothing = len(atoms) - 1
        second[:] = nothing
        second[is_plain] = np.where(marked, [places.get(m, nothing) for m in ends_in], nothing)
        ids = np.frombuffer(b"".join(atoms), "<u4")
        size = np.fromiter(map(len, atoms), np.int64, len(atoms)) // 4
        begin = np.cumsum(size) - size
        stream = np.empty(2 * len(at), np.int64)
        stream[0::2], stream[1::2] = first[at], second[at]
        lens = size[stream]
        total = np.concatenate([[0], np.cumsum(lens)])
        out = ids[np.repeat(begin[stream] - total[:-1], lens) + np.arange(total[-1])]
        return out, np.diff(total[2 * ends])


_encoders: dict[str, Encoder] = {}


def encoder(tokenizer_path: str) -> Encoder:
    """The worker's encoder, which tasks that run there one after another share."""
    if tokenizer_path not in _encoders:
        _encoders[tokenizer_path] = Encoder(tokenizer_path)
    return _encoders[tokenizer_path]


def slices(batch: pa.RecordBatch, column: int = 1, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts take about `most` bytes; a longer text is alone."""
    sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float))
    at = np.floor(np.cumsum(sizes) / most)
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(int(a), int(b - a))


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for) of every piece of every document."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        last = np.array([end], "<u4")
        for whole in it:
            for batch in slices(whole):
                ids, counts = encode(batch.column(1))
                cuts = np.concatenate([[0], np.cumsum(counts)])
                n = -(-(counts + 1) // capacity)
                row = np.repeat(np.arange(len(counts)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, counts[row] + 1 - start)
                parts = [ids[cuts[r] + s : min(cuts[r] + s + m, cuts[r + 1])] for r, s, m in zip(row, start, length, strict=True)]
                # The piece that has the end of its document has the end's id too.
                parts = [np.concatenate([p, last]) if len(p) < m else p for p, m in zip(parts, length, strict=True)]
                crc = [zlib.crc32(p.tobytes()) for p in parts]
                cols = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)
            del whole, batch, ids, parts
            pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def best_fit(lengths: np.ndarray, capacities: Sequence[float], weights: Sequence[float] = WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset in it of each piece of lengths. capacities and weights: of tokens, documents, attention cost."""
    if rule not in ("norm", "dot"):
        raise ValueError("rule has to be norm or dot")
    lengths = np.asarray(lengths, np.int64)
    caps, w = np.asarray(capacities, float), np.asarray(weights, float)
    if len(lengths) and lengths.max() > caps[0]:
        raise ValueError("a piece exceeds a sequence by itself")
    need = np.stack([lengths, np.ones_like(lengths), lengths**2], axis=1).astype(float)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left = np.zeros((max(16, len(lengths)), 3))  # of open bins by age, in places 0..n_open
    name = np.zeros(len(left), np.int64)
    n_open = n_bins = 0
    scale = w / caps**2
    for i in np.argsort(-lengths, kind="stable"):
        q, at = need[i], -1
        if n_open:
            room = left[:n_open]
            fits = np.flatnonzero((room[:, 0] >= q[0]) & (room[:, 1] >= q[1]) & (room[:, 2] >= q[2]))
            if len(fits):
                score = (room[fits] - q) ** 2 @ scale if rule == "norm" else -(room[fits] @ (q * scale))
                at = int(fits[np.argmin(score)])
        if at < 0:
            if q[2] > caps[2]:  # alone, whatever room there is
                bins[i], n_bins = n_bins, n_bins + 1
                continue
            at, n_open = n_open, n_open + 1
            left[at], name[at] = caps, n_bins
            n_bins += 1
        bins[i], offsets[i] = name[at], int(caps[0] - left[at, 0])
        left[at] -= q
        if (left[at] < 1).any():  # nothing fits any more; the others keep their order
            n_open -= 1
            left[at:n_open], name[at:n_open] = left[at + 1 : n_open + 1].copy(), name[at + 1 : n_open + 1].copy()
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, documents: int = DOCUMENTS, attention: float = ATTENTION, weights: Sequence[float] = WEIGHTS, rule: str = "norm", group: int = GROUP) -> DataFrame:
    """pieces (a written table with doc_id, piece, length and more) with sequence_id and offset.

    attention: the capacity of attention cost, as a part of the capacity squared.
    """
    caps = (float(capacity), float(documents), attention * capacity**2)
    groups = max(1, -(-pieces.count() // group))
    fields = [f for f in pieces.schema.fields if f.name not in ("sequence_id", "offset")]
    names = [f.name for f in fields]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__m")  # the same in a task that runs again
        bins, offsets = best_fit(pdf["length"].to_numpy(), caps, weights, rule)
        out = pdf[names].copy()
        out["sequence_id"] = int(pdf["__g"].iloc[0]) * (1 << 32) + bins
        out["offset"] = offsets
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"
    # The row's place in the written table tells repeated rows apart, and is the same in a task that runs again.
    dealt = pieces.select(*names, F.monotonically_increasing_id().alias("__m")).withColumn("__g", F.pmod(F.xxhash64("doc_id", "piece", "__m"), F.lit(groups)))
    return dealt.groupBy("__g").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return pack(staged(pieces_of(docs, tokenizer_path, capacity), "pack-pieces"), capacity, **options)


def sequence_ids(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, **options) -> DataFrame:
    """sequence_id, ids (its pieces' ids by offset): the packed sequences themselves, of unpadded length."""
    packed = pack(staged(pieces_of(docs, tokenizer_path, capacity, with_ids=True), "pack-pieces"), capacity, **options)
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
