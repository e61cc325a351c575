"""Token counts under a unigram vocabulary by dynamic programming over a trie.

A text's pre-tokens are its words with the word mark before each. Distinct pre-tokens are inserted in a trie; when a node is
made, the best forward score of its prefix follows from those of its ancestors, so a prefix that many words share is scored
once, and a word's terminal node has its number of tokens. Characters outside the vocabulary fall back to their bytes.

A worker keeps its trie from batch to batch and starts a new one at NODES nodes; counts don't depend on that. Nothing is
shuffled. Null, empty and white-space texts have no tokens, texts of any length are counted whole, repeated rows are counted each, an
empty table gives an empty one; extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from evisim.llm.packing import slices

MARK = "▁"
NODES = 600_000
#: Bytes of text, more or less, whose distinct words are looked up at once.
SLICE = 3_000_000
#: What a byte of a character outside the vocabulary scores below the lowest piece.
BYTE_PENALTY = 10.0


def ranked_pieces(model_path: str) -> list[tuple[str, float]]:
    """Pieces of a SentencePiece file with scores by Zipf's law over their rank from 0: -ln(rank + 2)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    ids.sort(key=lambda i: (-sp.get_score(i), i))
    return [(sp.id_to_piece(i), -math.log(rank + 2)) for rank, i in enumerate(ids)]


class Trie:
    """Nodes are numbers; the root is 0. Of equal scores the one whose last piece is longest counts."""

    def __init__(self, pieces: Sequence[tuple[str, float]]) -> None:
        self.score = dict(pieces)
        self.longest = max((len(p) for p in self.score), default=1)
        self.by_byte = min(self.score.values(), default=0.0) - BYTE_PENALTY
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.count = [0.0], [0]
        self.made = 0

    def insert(self, word: str) -> int:
        """The number of tokens of word."""
        child, node, path = self.child, 0, [0]
        for at, ch in enumerate(word):
            key = (node, ch)
            node = child.get(key, -1)
            if node < 0:
                node = child[key] = self._made(word, at + 1, path)
            path.append(node)
        return self.count[node]

    def _made(self, word: str, end: int, path: list[int]) -> int:
        score, best, count = self.score, self.best, self.count
        top, tokens = -math.inf, 0
        for begin in range(max(0, end - self.longest), end):
            s = score.get(word[begin:end])
            if s is not None and (v := best[path[begin]] + s) > top:
                top, tokens = v, count[path[begin]] + 1
        if word[end - 1] not in score:
            size = len(word[end - 1].encode("utf-8", "surrogatepass"))
            if (v := best[path[end - 1]] + size * self.by_byte) > top:
                top, tokens = v, count[path[end - 1]] + size
        best.append(top)
        count.append(tokens)
        self.made += 1
        return len(best) - 1


_tries: dict[str, Trie] = {}


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_words, n_tokens, max_word_tokens of every row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _tries:
            _tries[model_path] = Trie(ranked_pieces(model_path))
        trie = _tries[model_path]
        for whole in it:
            for batch in slices(whole, most=SLICE):
                lists = pc.ascii_split_whitespace(pc.fill_null(batch.column(1).cast(pa.large_string()), ""))
                ends, found = lists.offsets.to_numpy(), lists.flatten().dictionary_encode()
                counts = np.zeros(len(found.dictionary), np.int64)
                for i, word in enumerate(found.dictionary.to_pylist()):
                    if word:
                        if len(trie.best) > NODES:
                            trie.clear()
                        counts[i] = trie.insert(MARK + word)
                each = counts[found.indices.to_numpy(zero_copy_only=False)]
                sums = np.concatenate([[0], np.cumsum(each)])
                words = np.concatenate([[0], np.cumsum(each > 0)])
                tops = [int(each[a:b].max()) if b > a else 0 for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(words[ends])), pa.array(np.diff(sums[ends])), pa.array(tops, pa.int64())], names=["doc_id", "n_words", "n_tokens", "max_word_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long, max_word_tokens long")
