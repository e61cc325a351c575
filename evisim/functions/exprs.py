"""Scalar functions: Column in, Column out, no Python at run time."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def literal_map(values: Mapping[str, float], key: Column, default: float) -> Column:
    """The value of a key in a small literal table."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(float(v))) if out is None else out.when(key == k, F.lit(float(v)))
    return F.lit(float(default)) if out is None else out.otherwise(F.lit(float(default)))


def normalize_name(c: Column) -> Column:
    """Camel case to underscores, without a member prefix, lower case, no outer underscores."""
    c = F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1_$2")
    c = F.regexp_replace(c, r"^[msgp]_", "")
    return F.regexp_replace(F.lower(c), r"^_+|_+$", "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def words_of(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, "_"), lambda x: x != ""))


def partial_overlap(a: Column, b: Column) -> Column:
    """The shorter name's part of the longer if it lies in it, else the Jaccard similarity of their words."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    inside = (a.contains(b) | b.contains(a)) & (short > 0)
    return F.when(inside, short / long).otherwise(jaccard(words_of(a), words_of(b)))


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays, the shorter padded by zeros; 0 for a zero vector."""
    d = lambda x: F.transform(x, lambda v: v.cast("double"))
    dot = F.aggregate(F.zip_with(d(a), d(b), lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.sqrt(F.aggregate(d(x), F.lit(0.0), lambda s, v: s + v * v))
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(clamp(dot / size, -1.0, 1.0))


def size_ratio(a: Column, b: Column) -> Column:
    """Smaller over larger; 1 if both are 0."""
    top = F.greatest(a, b)
    return F.when(top == 0, 1.0).otherwise(F.least(a, b) / top)


def size_similarity(a: Column, b: Column) -> Column:
    top = F.greatest(a, b)
    return F.when(top == 0, 1.0).otherwise(1 - F.abs(a - b) / top)


def log_scale(c: Column, most: float) -> Column:
    """log1p over the scale's log1p, in [0, 1]."""
    return clamp(F.log1p(c) / F.log1p(F.lit(float(most))), 0.0, 1.0)


def auto_name(c: Column) -> Column:
    """Names that a disassembler makes up."""
    return c.rlike(r"^(thunk_|switch_)?FUN_[0-9a-fA-F]+$")


def auto_variable(c: Column) -> Column:
    return c.rlike(r"^(param_[0-9]+|local_[0-9a-fA-F]+|[a-z]{1,3}Var[0-9]+|undefined[0-9]*)$")


def meaningful_name(c: Column, least: int = 3) -> Column:
    return (F.length(c) >= least) & ~auto_name(c) & ~auto_variable(c) & c.rlike(r"^[A-Za-z][A-Za-z0-9]*(_[A-Za-z0-9]+)*$")


def constants(c: Column) -> Column:
    """Distinct decimal and hexadecimal constants from 16 to 2^32 - 1, sorted."""
    hexes = F.transform(F.regexp_extract_all(c, F.lit(r"\b0x([0-9a-fA-F]{1,8})\b"), F.lit(1)), lambda x: F.conv(x, 16, 10).cast("long"))
    decs = F.transform(F.regexp_extract_all(c, F.lit(r"\b([0-9]{2,10})\b"), F.lit(1)), lambda x: x.cast("long"))
    return F.array_sort(F.array_distinct(F.filter(F.concat(hexes, decs), lambda x: (x >= 16) & (x <= 4294967295))))


def cyclomatic(edges: Column, blocks: Column) -> Column:
    return edges - blocks + 2


def complexity_class(complexity: Column, loops: Column) -> Column:
    return F.when((complexity <= 1) & (loops == 0), "linear").when(loops > 0, F.when(complexity > 10, "complex").otherwise("looping")).when(complexity > 10, "complex").otherwise("branching")


def histogram_hash(histogram: Column) -> Column:
    """SHA-256 of a map's sorted key:value entries."""
    entries = F.transform(F.map_entries(histogram), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return F.sha2(F.array_join(F.array_sort(entries), "|"), 256)
