"""Similarity of names by words and their synonyms, merge branches that rest on it, code normalisation and token frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evisim.functions.exprs import clamp, jaccard, literal_map, logit, normalize_name, partial_overlap, sigmoid, words_of
from evisim.operators.evidence import MERGE_CLIP, MERGE_DROP, MERGE_WEIGHT

# Words that stand for one another in names.
GROUPS = (
    ("send", "transmit", "write", "emit", "dispatch", "post"),
    ("recv", "receive", "read", "get", "fetch"),
    ("init", "initialize", "setup", "create", "construct", "new", "alloc"),
    ("destroy", "cleanup", "teardown", "free", "delete", "release", "close", "dispose"),
    ("parse", "decode", "deserialize", "unmarshal", "extract"),
    ("serialize", "encode", "marshal", "format", "stringify"),
    ("handle", "process", "on", "dispatch", "callback", "handler"),
    ("check", "validate", "verify", "test", "assert", "is", "has"),
    ("lock", "acquire", "enter", "begin", "grab"),
    ("unlock", "release", "leave", "end", "drop"),
    ("add", "insert", "append", "push", "enqueue", "put"),
    ("remove", "delete", "erase", "pop", "dequeue", "take"),
    ("size", "length", "count", "num", "len", "total"),
    ("buf", "buffer", "data", "bytes", "payload", "blob"),
    ("msg", "message", "packet", "frame", "request", "response"),
    ("err", "error", "fault", "failure", "exception"),
    ("ctx", "context", "state", "env", "session"),
    ("cfg", "config", "configuration", "settings", "options", "prefs"),
    ("conn", "connection", "socket", "link", "channel"),
    ("log", "print", "trace", "debug", "info", "warn"),
)


def synonyms() -> dict[str, list[str]]:
    """Each word with the words of all its groups, in order."""
    out: dict[str, set[str]] = {}
    for group in GROUPS:
        for word in group:
            out.setdefault(word, set()).update(group)
    return {w: sorted(g) for w, g in sorted(out.items())}


def _table() -> Column:
    return F.create_map(*[x for w, g in synonyms().items() for x in (F.lit(w), F.array(*map(F.lit, g)))])


def expanded(words: Column) -> Column:
    """Words with their synonyms, each once."""
    return F.array_distinct(F.concat(words, F.flatten(F.transform(words, lambda w: F.coalesce(F.element_at(_table(), w), F.array().cast("array<string>"))))))


def semantically_similar(a: Column, b: Column, shared: float = 0.5, expanded_share: float = 0.3) -> Column:
    """Of two normalised names: half of the longer one's words in common, or three tenths of all with their synonyms."""
    x, y = words_of(a), words_of(b)
    common = F.size(F.array_intersect(x, y))
    return F.coalesce((common > 0) & (common >= shared * F.greatest(F.size(x), F.size(y))), F.lit(False)) | (jaccard(expanded(x), expanded(y)) >= expanded_share)


def equivalence(original: Column, recovered: Column, least: float = 0.40) -> Column:
    """exact, semantic, partial or wrong: equal when normalised, equal word sets with synonyms, enough common words."""
    a, b = normalize_name(original), normalize_name(recovered)
    x, y = words_of(a), words_of(b)
    stands = lambda p, q: F.forall(p, lambda w: F.arrays_overlap(expanded(F.array(w)), q))
    return F.when(a == b, "exact").when((F.size(x) > 0) & (F.size(y) > 0) & stands(x, y) & stands(y, x), "semantic").when(jaccard(x, y) >= least, "partial").otherwise("wrong")


def merge_names(candidates: DataFrame, weights: dict[str, float], drop: float = MERGE_DROP, semantic: float = 0.85) -> DataFrame:
    """symbol, name, confidence, method: the four branches of a merge of candidates(symbol, name, source, confidence, ord).

    A name of two sources or more wins by log-odds (the first of these). Else the pair of names that overlaps most, by a half at
    least: its shorter name, by log-odds with the weight 0.7 + 0.3 overlap. Else the first name's best semantically similar one,
    with `semantic` of its confidence. Else the best single one by its source's weight. Names of a symbol are few, and meet
    within the symbol only.
    """
    w = literal_map(weights, F.col("source"), MERGE_WEIGHT)
    odds = logit(clamp(F.col("confidence"), *MERGE_CLIP))
    per = candidates.withColumn("name", normalize_name(F.col("name"))).groupBy("symbol", "name").agg(
        F.sum(w * odds).alias("odds"), F.sum(odds).alias("plain"), F.countDistinct("source").alias("sources"), F.max(F.col("confidence") * w).alias("damped"), F.max("confidence").alias("top"), F.min("ord").alias("ord")
    )
    belief = lambda x: clamp(sigmoid(clamp(x, -20.0, 20.0)), *MERGE_CLIP)
    first = lambda df, *order: df.withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy(*order))).filter("rn = 1")
    exact = first(per.filter("sources >= 2"), F.asc("ord")).select("symbol", "name", belief(F.col("odds")).alias("confidence"), F.lit("exact_multi").alias("method"), F.lit(0).alias("rank"))
    other = per.select("symbol", F.col("name").alias("n2"), F.col("plain").alias("p2"), F.col("top").alias("t2"), F.col("ord").alias("o2"))
    pairs = per.join(other, "symbol").filter("ord < o2 AND name <> n2")
    overlap = partial_overlap(F.col("name"), F.col("n2"))
    shorter = F.when(F.length("n2") < F.length("name"), F.col("n2")).otherwise(F.col("name"))
    near = first(pairs.withColumn("overlap", overlap).filter("overlap >= 0.5"), F.desc("overlap"), F.asc("ord"), F.asc("o2"))
    partial = near.select("symbol", shorter.alias("name"), belief((F.col("plain") + F.col("p2")) * (0.7 + 0.3 * F.col("overlap"))).alias("confidence"), F.lit("partial").alias("method"), F.lit(1).alias("rank"))
    alike = first(pairs.filter(semantically_similar(F.col("name"), F.col("n2"))), F.asc("ord"), F.desc("t2"), F.asc("o2"))
    better = F.col("t2") > F.col("top")
    group = alike.select("symbol", F.when(better, F.col("n2")).otherwise(F.col("name")).alias("name"), (F.greatest("top", "t2") * semantic).alias("confidence"), F.lit("semantic").alias("method"), F.lit(2).alias("rank"))
    single = first(per, F.desc("damped"), F.asc("ord")).select("symbol", "name", F.col("damped").alias("confidence"), F.lit("single").alias("method"), F.lit(3).alias("rank"))
    every = exact.unionByName(partial).unionByName(group).unionByName(single)
    return first(every, F.asc("rank")).drop("rn", "rank").filter(F.col("confidence") >= drop)


# Words of C that aren't function names.
KEYWORDS = (
    "if", "else", "while", "for", "do", "switch", "case", "return", "break", "continue", "goto", "sizeof", "typeof", "struct", "union", "enum", "typedef", "const", "static", "extern",
    "volatile", "register", "inline", "void", "int", "char", "short", "long", "float", "double", "unsigned", "signed", "bool",
)


def anonymous_code(c: Column) -> Column:
    """Code with addresses, functions, generated variables and white space made alike: equal bodies are equal whatever their names."""
    c = F.regexp_replace(c, r"\b(?:0x[0-9a-fA-F]+|[0-9a-fA-F]{8,})\b", "ADDR")
    c = F.regexp_replace(c, r"\bFUN_[0-9a-fA-F]+\b", "FUNC")
    c = F.regexp_replace(c, r"\b(?:local_|param_|uVar|iVar|lVar|cVar|sVar|bVar|unaff_|in_)[0-9a-zA-Z_]*\b", "VAR")
    c = F.regexp_replace(c, r"\b(?!(?:" + "|".join(KEYWORDS) + r")\s*\()[a-zA-Z_]\w*\s*\(", "FUNC(")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def flank_frames(docs: DataFrame, mark: str, flank: int, text: str = "text", id_: str = "doc_id", pad: str = "??") -> DataFrame:
    """id, at, frame: for each word that matches `mark`, the `flank` words on both sides of it, padded beyond the text's ends.

    Frames are cut from the row's own words, so nothing is shuffled.
    """
    words = F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    edge = F.array_repeat(F.lit(pad), flank)
    rows = docs.select(F.col(id_), F.concat(edge, words, edge).alias("w"))
    hits = F.filter(F.transform("w", lambda x, i: F.when(x.rlike(mark) & (i >= flank) & (i < F.size("w") - flank), i)), lambda i: i.isNotNull())
    return rows.select(id_, "w", F.explode(hits).alias("i")).select(id_, (F.col("i") - flank).cast("long").alias("at"), F.array_join(F.concat(F.slice("w", F.col("i") - flank + 1, F.lit(flank)), F.slice("w", F.col("i") + 2, F.lit(flank))), " ").alias("frame"))
