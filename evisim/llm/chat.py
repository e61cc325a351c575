"""Chat formatting into budgeted, turn-aligned windows with a loss mask, and reading it back.

A conversation's turns go by turn number. Prefix sums of turn tokens choose where a window ends (a search in them, not a
running total): the longest run of turns that, with the retained system turn and the repeated history before them, stays within
the budget. A turn is never cut. Later windows repeat the system turn and up to HISTORY_TURNS turns of at most HISTORY_TOKENS.
What a window repeats is marked so and masked; each assistant turn is a target once.

The budget is hard. A window repeats the system turn only if that leaves room for the first new turn, and no more history than
there is room for after both; a system turn of more than SYSTEM_SHARE of the budget is repeated in no window. So a window
exceeds the budget only if it is one turn that does so by itself, with nothing repeated.

Format of a turn: `### role: text</turn>` and a line feed, with `~` before a repeated turn's role. In texts and roles a
backslash goes before every backslash, `### ` and `</turn>` (in roles also before `:` and `~`), so nothing in a text reads as
a mark, and dropping those backslashes gives the text back.

Tasks stream over rows sorted by conversation and turn and encode a batch of turns at once: they hold a batch and a window's
turns, however long the conversation or a text is. An empty table gives no windows. Null roles and texts are empty. Rows of one turn number go by role, then text; repeated rows are turns of their own. Null
conv_ids form one conversation. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

BUDGET = 1024
HISTORY_TURNS = 2
HISTORY_TOKENS = 256
#: A longer system turn, as a part of the budget, isn't repeated.
SYSTEM_SHARE = 0.5
#: Tokens that a turn's marks count for.
TURN_TOKENS = 8

WINDOWS = "conv_id long, window int, n_new int, n_repeated int, tokens long, text string, spans array<struct<start: int, stop: int>>"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"

_TURN = re.compile(r"### (~?)((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
_CONTROL = re.compile(r"\\|### |</turn>")
_ROLE_CONTROL = re.compile(r"\\|### |</turn>|[:~]")


def escape(text: str, role: bool = False) -> str:
    return (_ROLE_CONTROL if role else _CONTROL).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[bool, str, str]]) -> tuple[str, list[dict[str, int]]]:
    """The text of a window of (repeated, role, text), and the spans of its targets in code points."""
    out, spans, at = [], [], 0
    for again, role, text in turns:
        head, body = f"### {'~' * again}{escape(role, True)}: ", escape(text)
        if role == "assistant" and not again:
            spans.append({"start": at + len(head), "stop": at + len(head) + len(body)})
        out.append(f"{head}{body}</turn>\n")
        at += len(out[-1])
    return "".join(out), spans


def parse(text: str) -> Iterator[tuple[bool, str, str]]:
    """(repeated, role, text) of each turn of a window."""
    at = 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at code point {at}")
        yield bool(m[1]), unescape(m[2]), unescape(m[3])
        at = m.end()


class Conversation:
    """Turns of one conversation that no window has yet, and the few before them that the next may repeat."""

    def __init__(self, budget: int, history_turns: int, history_tokens: int, system_share: float = SYSTEM_SHARE) -> None:
        self.budget, self.history_turns, self.history_tokens, self.system_share = budget, history_turns, history_tokens, system_share
        self.turns: list[tuple[str, str]] = []
        self.prefix = [0]  # tokens of the turns before each
        self.start = self.windows = 0  # the first new turn, and windows so far
        self.system: tuple[str, str] | None = None
        self.system_tokens = self.leads = 0  # leads: whether the first turn held is the system turn

    def add(self, role: str, text: str, tokens: int) -> None:
        if not self.turns and not self.windows and role == "system":
            self.system, self.system_tokens, self.leads = (role, text), tokens, 1
        self.turns.append((role, text))
        self.prefix.append(self.prefix[-1] + tokens)

    def take(self, final: bool) -> Iterator[tuple[list[tuple[bool, str, str]], int]]:
        """The windows that are settled, each as turns and tokens; with `final`, all that is left."""
        prefix = self.prefix
        while self.start < len(self.turns):
            start, room, repeated = self.start, self.budget, []
            own = prefix[start + 1] - prefix[start]
            if self.windows:
                if self.system and self.system_tokens <= self.system_share * self.budget and self.system_tokens + own <= room:
                    repeated, room = [self.system], room - self.system_tokens
                # The first window starts with the system turn, which history leaves out.
                oldest = max(start - self.history_turns, self.leads)
                past = bisect_left(prefix, prefix[start] - max(0, min(self.history_tokens, room - own)), oldest, start) if oldest < start else start
                repeated, room = repeated + self.turns[past:start], room - (prefix[start] - prefix[past])
            end = max(start + 1, bisect_right(prefix, prefix[start] + room) - 1)
            if end == len(self.turns) and not final:
                break
            yield [(True, *t) for t in repeated] + [(False, *t) for t in self.turns[start:end]], self.budget - room + prefix[end] - prefix[start]
            self.windows += 1
            self.start = end
        self._forget()

    def _forget(self) -> None:
        gone = self.start - self.history_turns
        if gone > 0:
            self.turns, self.prefix, self.start, self.leads = self.turns[gone:], self.prefix[gone:], self.start - gone, 0


def _rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in it:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _by_first(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Runs of rows with equal first value; each run is read before the next."""
    row = next(rows, None)
    while row is not None:
        key = row[0]

        def run() -> Iterator[tuple]:
            nonlocal row
            while row is not None and row[0] == key:
                yield row
                row = next(rows, None)

        part = run()
        yield key, part
        for _ in part:
            pass


def _out(rows: Iterator[tuple], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_WINDOW_ARROW = pa.schema([("conv_id", pa.int64()), ("window", pa.int32()), ("n_new", pa.int32()), ("n_repeated", pa.int32()), ("tokens", pa.int64()), ("text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])
_READ_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])


def format_chats(turns: DataFrame, tokenizer_path: str | None = None, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """A row per window: conv_id, window, n_new, n_repeated, tokens, text, spans (of its targets).

    Tokens are the vocabulary's; without one, words.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path is None:
            costs = lambda texts: np.fromiter((len(t.split()) for t in texts.to_pylist()), np.int64, len(texts))
        else:
            from evisim.llm.packing import encoder, slices

            encode = encoder(tokenizer_path).encode

            def costs(texts: pa.Array) -> np.ndarray:
                parts = slices(pa.RecordBatch.from_arrays([texts], names=["t"]), 0)
                return np.concatenate([encode(p.column(0))[1] for p in parts])

        def shown(conv: object, held: Conversation, final: bool) -> Iterator[tuple]:
            first = held.windows
            for k, (window, tokens) in enumerate(held.take(final)):
                text, spans = render(window)
                again = sum(a for a, _, _ in window)
                yield conv, first + k, len(window) - again, again, tokens, text, spans

        def rows() -> Iterator[tuple]:
            conv, held = None, None
            for batch in it:
                texts = pc.fill_null(batch.column(3), "")
                tokens = costs(texts) + TURN_TOKENS if batch.num_rows else ()
                for c, role, text, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), texts.to_pylist(), tokens, strict=True):
                    if held is None or c != conv:
                        if held is not None:
                            yield from shown(conv, held, True)
                        conv, held = c, Conversation(budget, history_turns, history_tokens)
                    held.add(role or "", text, int(n))
                if held is not None:
                    yield from shown(conv, held, False)
            if held is not None:
                yield from shown(conv, held, True)

        yield from _out(rows(), _WINDOW_ARROW)

    ordered = turns.select(F.col("conv_id").cast("long"), "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, WINDOWS)


def read_chats(windows: DataFrame) -> DataFrame:
    """What the windows of each conversation say: its turns' digest, and the digest of all text under the loss mask."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for conv, part in _by_first(_rows(it)):
                turns, loss, n, chars, size, count = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
                for _, _, text, spans in part:
                    count, size = count + 1, size + len(text)
                    for again, role, body in parse(text):
                        if not again:
                            n += 1
                            turns.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                    for s in spans:
                        target = unescape(text[s["start"] : s["stop"]])
                        chars += len(target)
                        loss.update(target.encode("utf-8", "surrogatepass"))
                yield conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, count

        yield from _out(rows(), _READ_ARROW)

    ordered = windows.select("conv_id", "window", "text", "spans").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.mapInArrow(run, READ)
