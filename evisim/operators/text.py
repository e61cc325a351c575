"""Text scans: normalised code, n-grams, entropy, readability, rules, versions. All in built-in functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|0x[0-9a-fA-F]+|[0-9]+|[^\sA-Za-z0-9_]"


def normalize_code(c: Column) -> Column:
    """Comments out; addresses, generated names, numbers and white space made alike."""
    steps = (
        (r"/\*[^*]*\*+([^/*][^*]*\*+)*/", " "),
        (r"//[^\n]*", " "),
        (r"\b(FUN|sub|thunk)_[0-9a-fA-F]+\b", "FUNC"),
        (r"\b(DAT|PTR|LAB)_[0-9a-fA-F]+\b", "DATA"),
        (r"\blocal_[0-9a-fA-F]+\b", "LOCAL"),
        (r"\bparam_[0-9]+\b", "PARAM"),
        (r"\b[a-z]{1,3}Var[0-9]+\b", "VAR"),
        (r"\b0x[0-9a-fA-F]+\b", "HEX"),
        (r"\s+", " "),
    )
    for pattern, new in steps:
        c = F.regexp_replace(c, pattern, new)
    return F.trim(c)


def code_groups(bodies: DataFrame) -> DataFrame:
    """digest, n, first (smallest func_id) of bodies with equal normalised code."""
    return bodies.groupBy(F.sha2(normalize_code(F.col("code")), 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("func_id").alias("first"))


def entropy(c: Column) -> Column:
    """Shannon entropy of a text's characters in bits; 0 for the empty text.

    Characters are sorted within the row and counted by runs, so nothing is exploded.
    """
    chars = F.array_sort(F.filter(F.split(c, ""), lambda x: x != ""))
    start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("s"))

    def step(acc: Column, x: Column) -> Column:
        same = acc["last"] == x
        closed = acc["s"] + F.when(acc["run"] > 0, acc["run"] * F.log2(acc["run"])).otherwise(0.0)
        return F.struct(x.alias("last"), F.when(same, acc["run"] + 1.0).otherwise(1.0).alias("run"), F.when(same, acc["s"]).otherwise(closed).alias("s"))

    total = F.aggregate(chars, start, step, lambda a: a["s"] + F.when(a["run"] > 0, a["run"] * F.log2(a["run"])).otherwise(0.0))
    n = F.length(c)
    return F.when(n == 0, 0.0).otherwise(F.log2(n.cast("double")) - total / n)


def entropies(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """id, entropy of every text's characters in bits; 0 for the empty text, null for null.

    Over Arrow batches: a text's code points are sorted and counted as an array, which built-in functions can only do one by one.
    """
    import numpy as np
    import pyarrow as pa

    def run(it):
        for batch in it:
            out = []
            for t in batch.column(1).to_pylist():
                if not t:
                    out.append(None if t is None else 0.0)
                    continue
                points = np.sort(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4"))
                n = np.diff(np.flatnonzero(np.concatenate([[True], points[1:] != points[:-1], [True]]))) / len(points)
                out.append(float(-(n * np.log2(n)).sum()) + 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=[id_, "entropy"])

    return docs.select(id_, text).mapInArrow(run, f"{id_} {docs.schema[id_].dataType.simpleString()}, entropy double")


def nesting(c: Column) -> Column:
    """The greatest depth of brackets."""
    marks = F.regexp_extract_all(c, F.lit(r"[{}()]"), F.lit(0))
    up = lambda x: F.when(x.isin("{", "("), 1).otherwise(-1)
    return F.aggregate(marks, F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), lambda a, x: F.struct((a["d"] + up(x)).alias("d"), F.greatest(a["m"], a["d"] + up(x)).alias("m")), lambda a: a["m"])


def readability(dims: DataFrame) -> DataFrame:
    """id, score of dims(id, names, params, locals, types, comments, structure), each 0 to 100."""
    weights = (("names", 0.25), ("params", 0.15), ("locals", 0.15), ("types", 0.20), ("comments", 0.10), ("structure", 0.15))
    return dims.select("id", sum((F.col(n) * w for n, w in weights[1:]), F.col("names") * 0.25).alias("score"))


def structure_score(avg_nest: Column, gotos: Column, avg_len: Column) -> Column:
    """100 less 5 a level of nesting, 10 a goto, and up to 40 for functions of 50 to 150 lines."""
    penalty = F.least(F.greatest((avg_len - 50) / 100 * 40, F.lit(0.0)), F.lit(40.0))
    return F.least(F.greatest(100 - (5 * avg_nest + 10 * gotos + penalty), F.lit(0.0)), F.lit(100.0))


def ngram_counts(docs: DataFrame, n: int, name: str, text: str = "text", top: int = 5, least: int = 2) -> DataFrame:
    """digest, name, n, total, rn: how often each name goes with each n-gram of words; the commonest names of an n-gram.

    Counting is partial before the shuffle; n-grams are keyed by a digest of their words.
    """
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    grams = F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), "\u0001")))
    rows = docs.select(words.alias("w"), F.col(name).alias("name")).select("name", F.explode(grams).alias("g"))
    per = rows.groupBy("g", "name").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("g")
    out = per.withColumn("total", F.sum("n").over(w)).filter(F.col("total") >= least).withColumn("rn", F.row_number().over(w.orderBy(F.desc("n"), "name")))
    return out.filter(F.col("rn") <= top).select(F.substring(F.sha2("g", 256), 1, 24).alias("digest"), "name", "n", "total", "rn")


def rule_scan(docs: DataFrame, rules: Sequence[tuple[str, str, str]], text: str = "text", id_: str = "doc_id") -> DataFrame:
    """id, rule, n of rules(name, literal, pattern): a rule's cheap literal is looked for before its pattern runs."""
    t = F.col(text)
    found = F.array(*[F.struct(F.lit(name).alias("rule"), F.when(t.contains(literal), F.regexp_count(t, F.lit(pattern))).otherwise(0).cast("long").alias("n")) for name, literal, pattern in rules])
    return docs.select(F.col(id_), F.explode(F.filter(found, lambda x: x["n"] > 0)).alias("r")).select(id_, "r.rule", "r.n")


def string_clusters(strings: DataFrame, groups: Sequence[tuple[str, str]], most: int = 50, width: int = 200) -> DataFrame:
    """category, n, evidence of strings(value): a string may be in many groups; evidence is the first `most` distinct ones in order."""
    v = F.col("value")
    hits = strings.select("value", F.explode(F.filter(F.array(*[F.when(v.rlike(p), F.lit(c)) for c, p in groups]), lambda x: x.isNotNull())).alias("category"))
    per = hits.groupBy("category", F.substring("value", 1, width).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = per.groupBy("category").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("category").orderBy("value")
    few = per.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most).groupBy("category").agg(F.array_join(F.array_sort(F.collect_list("value")), ";").alias("evidence"))
    return total.join(few, "category")


def versions(strings: DataFrame, patterns: Sequence[tuple[str, str]]) -> DataFrame:
    """library, version, n of strings(value) by one pattern per library, its first group the version."""
    v = F.col("value")
    found = F.array(*[F.struct(F.lit(lib).alias("library"), F.regexp_extract(v, p, 1).alias("version")) for lib, p in patterns])
    return strings.select(F.explode(F.filter(found, lambda x: x["version"] != "")).alias("r")).groupBy("r.library", "r.version").agg(F.count(F.lit(1)).alias("n"))


def gap_groups(items: DataFrame, gap: int = 100, least: int = 3) -> DataFrame:
    """group, first, last, n of items(group, pos): runs whose neighbours lie within the gap, of `least` items or more."""
    w = Window.partitionBy("group").orderBy("pos")
    cut = F.when(F.col("pos") - F.lag("pos").over(w) <= gap, 0).otherwise(1)
    runs = items.withColumn("cut", cut).withColumn("run", F.sum("cut").over(w))
    return runs.groupBy("group", "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).drop("run")
