"""What built-in functions can't express: unbounded nesting, automata, per-function graph algorithms. Arrow batches or groups only."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def split_arguments(text: str) -> list[str]:
    """Top-level arguments of the first balanced parentheses; commas in nested brackets or quotes don't split."""
    start = text.find("(")
    if start < 0:
        return []
    out, depth, quote, last, i = [], 0, "", start + 1, start
    while i < len(text):
        ch = text[i]
        if quote:
            if ch == "\\":
                i += 1
            elif ch == quote:
                quote = ""
        elif ch in "\"'":
            quote = ch
        elif ch in "([{":
            depth += 1
        elif ch in ")]}":
            depth -= 1
            if depth == 0:
                out.append(text[last:i].strip())
                return out if out != [""] else []
        elif ch == "," and depth == 1:
            out.append(text[last:i].strip())
            last = i + 1
        i += 1
    return []


def call_arguments(c: str) -> Column:
    """The top-level arguments of a column of calls."""

    @F.pandas_udf("array<string>")
    def run(calls: pd.Series) -> pd.Series:
        return calls.map(lambda t: None if t is None else split_arguments(t))

    return run(c)


def replace_words(df: DataFrame, column: str, names: Mapping[str, str]) -> DataFrame:
    """Whole words replaced at once, the leftmost and longest first, so replacements aren't replaced again. The dictionary is sent with the function."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(n) for n in sorted(names, key=lambda n: (-len(n), n))) + r")(?!\w)") if names else None
        for batch in it:
            at = batch.schema.get_field_index(column)
            new = [None if t is None else pattern.sub(lambda m: names[m[0]], t) if pattern else t for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, column, pa.array(new, pa.string()))

    return df.mapInArrow(run, df.schema)


def find_words(df: DataFrame, id_: str, column: str, words: Sequence[str]) -> DataFrame:
    """id, word, pos of the first whole-word hit in each text, by an automaton over all words."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        auto = ahocorasick.Automaton()
        for w in words:
            auto.add_word(w, w)
        auto.make_automaton()
        for batch in it:
            ids, found, places = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                best = None
                for end, w in auto.iter(text or "") if words else ():
                    begin = end - len(w) + 1
                    whole = not (begin and (text[begin - 1].isalnum() or text[begin - 1] == "_")) and not (end + 1 < len(text) and (text[end + 1].isalnum() or text[end + 1] == "_"))
                    if whole and (best is None or (begin, -len(w)) < (best[0], -len(best[1]))):
                        best = (begin, w)
                if best:
                    ids.append(i)
                    places.append(best[0])
                    found.append(best[1])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string()), pa.array(places, pa.int64())], names=["id", "word", "pos"])

    return df.select(F.col(id_).cast("long").alias("id"), F.col(column)).mapInArrow(run, "id long, word string, pos long")


def dominators_of(edges: Sequence[tuple[int, int]], entry: int) -> dict[int, int]:
    """Immediate dominators of the nodes reachable from entry, by intersecting predecessors in reverse postorder until nothing changes."""
    succ: dict[int, list[int]] = {}
    pred: dict[int, list[int]] = {}
    for a, b in edges:
        succ.setdefault(a, []).append(b)
        pred.setdefault(b, []).append(a)
    order, seen, stack = [], {entry}, [(entry, iter(succ.get(entry, ())))]
    while stack:
        node, rest = stack[-1]
        for n in rest:
            if n not in seen:
                seen.add(n)
                stack.append((n, iter(succ.get(n, ()))))
                break
        else:
            order.append(node)
            stack.pop()
    place = {n: i for i, n in enumerate(reversed(order))}
    idom = {entry: entry}
    changed = True
    while changed:
        changed = False
        for n in sorted(place, key=place.get):
            if n == entry:
                continue
            new = None
            for p in pred.get(n, ()):
                if p in idom:
                    a, b = p, new if new is not None else p
                    while a != b:
                        a, b = (idom[a], b) if place[a] > place[b] else (a, idom[b])
                    new = a
            if new is not None and idom.get(n) != new:
                idom[n], changed = new, True
    return idom


def loops_of(edges: Sequence[tuple[int, int]], entry: int) -> dict[int, set[int]]:
    """Natural loops: headers and their nodes, from edges whose target dominates their source."""
    idom = dominators_of(edges, entry)
    pred: dict[int, list[int]] = {}
    for a, b in edges:
        pred.setdefault(b, []).append(a)

    def dominates(a: int, b: int) -> bool:
        while b != a and idom[b] != b:
            b = idom[b]
        return a == b

    out: dict[int, set[int]] = {}
    for a, b in edges:
        if a in idom and b in idom and dominates(b, a):
            body, todo = out.setdefault(b, {b}), [a]
            while todo:
                n = todo.pop()
                if n not in body:
                    body.add(n)
                    todo += [p for p in pred.get(n, ()) if p in idom]
    return out


def function_dominators(cfg: DataFrame) -> DataFrame:
    """func, node, idom, depth (loops around it) of cfg(func, src, dst); a function's entry is its smallest node.

    Tasks stream over rows sorted by function and hold one function's edges.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def functions() -> Iterator[tuple[int, set[tuple[int, int]]]]:
            func, edges = None, set()
            for batch in it:
                for f, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if f != func and edges:
                        yield func, edges
                        edges = set()
                    func = f
                    edges.add((a, b))
            if edges:
                yield func, edges

        held: list[tuple[int, int, int, int]] = []
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32())
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=["func", "node", "idom", "depth"])
        for func, found in functions():
            edges = sorted(found)
            entry = min(min(e) for e in edges)
            idom, loops = dominators_of(edges, entry), loops_of(edges, entry)
            held += [(func, n, idom[n], sum(n in body for body in loops.values())) for n in sorted(idom)]
            if len(held) > 10_000:
                yield out()
                held.clear()
        if held:
            yield out()

    ordered = cfg.select(*[F.col(c).cast("long") for c in ("func", "src", "dst")]).dropna().repartition("func").sortWithinPartitions("func")
    return ordered.mapInArrow(run, "func long, node long, idom long, depth int")


def embeds(pattern: Sequence[tuple[int, int]], target: Sequence[tuple[int, int]], labels: Mapping[int, object] | None = None, target_labels: Mapping[int, object] | None = None, budget: int = 100_000) -> bool | None:
    """Whether the pattern's graph is a subgraph of the target's, by backtracking over nodes of falling degree; None if the budget of steps ran out."""
    nodes = sorted({n for e in pattern for n in e}, key=lambda n: (-sum(n in e for e in pattern), n))
    p, t = set(pattern), set(target)
    candidates = sorted({n for e in target for n in e})
    degree = lambda es, n: (sum(a == n for a, _ in es), sum(b == n for _, b in es))
    dt = {n: degree(t, n) for n in candidates}
    fits = {n: [c for c in candidates if dt[c][0] >= degree(p, n)[0] and dt[c][1] >= degree(p, n)[1] and (labels is None or labels.get(n) == (target_labels or {}).get(c))] for n in nodes}
    steps = 0

    def place(i: int, at: dict[int, int]) -> bool | None:
        nonlocal steps
        if i == len(nodes):
            return True
        n = nodes[i]
        for c in fits[n]:
            steps += 1
            if steps > budget:
                return None
            if c in at.values():
                continue
            at[n] = c
            if all((at[a], at[b]) in t for a, b in p if a in at and b in at and n in (a, b)) and (got := place(i + 1, at)) is not False:
                return got
            del at[n]
        return False

    return place(0, {})


def verify_subgraphs(pairs: DataFrame, budget: int = 100_000) -> DataFrame:
    """pairs(id, pattern, target: arrays of [src, dst]) with `embeds`; candidates only, as verification is exponential at worst."""

    @F.pandas_udf("boolean")
    def check(a: pd.Series, b: pd.Series) -> pd.Series:
        edges = lambda x: [tuple(map(int, e)) for e in x]
        return pd.Series([embeds(edges(p), edges(t), budget=budget) for p, t in zip(a, b, strict=True)], dtype=object)

    return pairs.withColumn("embeds", check("pattern", "target"))


def demangle_name(name: str) -> str | None:
    """Nested names of the common C++ scheme (_ZN...E or _Z<name>): scopes joined by ::; None for anything else."""
    body = name[2:] if name.startswith("_Z") else None
    if body is None:
        return None
    nested = body.startswith("N")
    body = re.sub(r"^N[rVK]*", "", body)
    out, at = [], 0
    while m := re.match(r"(\d+)", body[at:]):
        n = int(m[1])
        at += len(m[1])
        if at + n > len(body):
            return None
        out.append(body[at : at + n])
        at += n
        if not nested:
            break
    return "::".join(out) if out and (not nested or body[at : at + 1] in ("E", "C", "D", "I")) else None


def demangle(c: str) -> Column:
    """The plain names of a column of mangled ones."""

    @F.pandas_udf("string")
    def run(names: pd.Series) -> pd.Series:
        return names.map(lambda n: None if n is None else demangle_name(n))

    return run(c)


def top_level_statements(code: str) -> list[str]:
    """A script cut after each statement or block at depth 0."""
    out, depth, quote, last, i = [], 0, "", 0, 0
    while i < len(code):
        ch = code[i]
        if quote:
            if ch == "\\":
                i += 1
            elif ch == quote:
                quote = ""
        elif ch in "\"'`":
            quote = ch
        elif ch in "([{":
            depth += 1
        elif ch in ")]}":
            depth -= 1
            if depth == 0 and ch == "}":
                out.append(code[last : i + 1].strip())
                last = i + 1
        elif ch == ";" and depth == 0:
            out.append(code[last : i + 1].strip())
            last = i + 1
        i += 1
    out.append(code[last:].strip())
    return [s for s in out if s]


def chunked_scripts(scripts: DataFrame, size: int) -> DataFrame:
    """path, chunk, code of scripts(path, code): top-level statements gathered to chunks of about `size` characters."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows: list[tuple[str, int, str]] = []
            for path, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held: deque[str] = deque()
                total = n = 0
                for s in top_level_statements(code or ""):
                    if held and total + len(s) > size:
                        rows.append((path, n, "\n".join(held)))
                        held.clear()
                        total, n = 0, n + 1
                    held.append(s)
                    total += len(s)
                if held:
                    rows.append((path, n, "\n".join(held)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string()))], names=["path", "chunk", "code"])

    return scripts.select("path", "code").mapInArrow(run, "path string, chunk int, code string")


def blake2b(c: Column) -> Column:
    """16 bytes of BLAKE2b in hex."""
    import hashlib

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else hashlib.blake2b(t.encode(), digest_size=16).hexdigest())

    return digest(c)
