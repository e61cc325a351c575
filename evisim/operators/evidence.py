"""Fusion and calibration of evidence rows. Every operator aggregates once; nothing depends on row order unless it says so."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from evisim.functions.exprs import clamp, literal_map, logit, sigmoid

#: Weights of evidence sources and the cap of a mass.
MASS_WEIGHTS = {"signature": 0.55, "string": 0.65, "api": 0.80, "callgraph": 0.60, "engineering": 0.50}
MASS_CAP = 0.95
MERGE_PRIOR, MERGE_WEIGHT, MERGE_CLIP, MERGE_DROP = 0.5, 0.7, (0.01, 0.99), 0.30


def noisy_or(evidence: DataFrame, digits: int = 3, cap: float = 0.98, structural_cap: float = 0.50, strong: float = 0.70, strong_cap: float = 0.69) -> DataFrame:
    """function, name, confidence, methods, n of evidence(function, name, method, confidence).

    Names group by their trimmed lower case. One row passes unchanged. Structural evidence alone is capped, and a strong result
    needs two methods or an api.
    """
    group = evidence.groupBy("function", F.lower(F.trim("name")).alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.max("confidence").alias("top"), F.product(1 - F.col("confidence")).alias("miss"), F.array_sort(F.collect_set("method")).alias("m")
    )
    fused = 1 - F.col("miss")
    fused = F.when((F.size("m") == 1) & (F.col("m")[0] == "structural"), F.least(fused, F.lit(structural_cap))).otherwise(fused)
    fused = F.when((fused >= strong) & (F.size("m") < 2) & ~F.array_contains("m", "api"), F.lit(strong_cap)).otherwise(fused)
    fused = F.when(F.col("n") == 1, F.col("top")).otherwise(F.least(fused, F.lit(cap)))
    return group.select("function", "name", F.bround(fused, digits).alias("confidence"), F.array_join("m", "+").alias("methods"), "n")


def belief_mass(evidence: DataFrame, weights: Mapping[str, float] = MASS_WEIGHTS, cap: float = MASS_CAP) -> DataFrame:
    """evidence(kind, quality, ...) with mass = weight * quality up to the cap; engineering quality comes from its count of hits."""
    quality = F.when(F.col("kind") == "engineering", F.least(0.3 + 0.15 * F.col("hits"), F.lit(0.9))).otherwise(F.col("quality"))
    return evidence.withColumn("mass", F.least(literal_map(weights, F.col("kind"), 0.0) * quality, F.lit(cap)))


def dempster_shafer(masses: DataFrame, cap: float = 0.98) -> DataFrame:
    """symbol, hypothesis, belief, agreement, conflict of masses(symbol, hypothesis, source, mass).

    With no mass against a hypothesis the combination is 1 - prod(1 - m) in any order. The strongest hypothesis wins, ties by
    name; conflict is the second belief over the first.
    """
    per = masses.groupBy("symbol", "hypothesis").agg(F.least(1 - F.product(1 - F.col("mass")), F.lit(cap)).alias("belief"), F.countDistinct("source").alias("agreement"))
    w = Window.partitionBy("symbol").orderBy(F.desc("belief"), "hypothesis")
    ranked = per.withColumn("second", F.lead("belief").over(w)).withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    return ranked.select("symbol", "hypothesis", "belief", "agreement", F.coalesce(F.col("second") / F.col("belief"), F.lit(0.0)).alias("conflict"))


def log_odds_merge(candidates: DataFrame, weights: Mapping[str, float], prior: float = MERGE_PRIOR, default_weight: float = MERGE_WEIGHT) -> DataFrame:
    """symbol, name, confidence, n of candidates(symbol, name, source, confidence): sigmoid of the prior's and weighted log-odds."""
    low, high = MERGE_CLIP
    odds = F.sum(literal_map(weights, F.col("source"), default_weight) * logit(clamp(F.col("confidence"), low, high)))
    total = clamp(F.lit(0.0) + odds + logit(F.lit(prior)), -20.0, 20.0)
    per = candidates.groupBy("symbol", "name").agg(total.alias("odds"), F.count(F.lit(1)).alias("n"))
    return per.select("symbol", "name", clamp(sigmoid(F.col("odds")), low, high).alias("confidence"), "n")


def merge_decision(candidates: DataFrame, weights: Mapping[str, float], drop: float = MERGE_DROP) -> DataFrame:
    """symbol, name, confidence, method: names with two sources or more win by log-odds, else the best single damped by its weight."""
    per = candidates.groupBy("symbol", "name").agg(
        F.sum(literal_map(weights, F.col("source"), MERGE_WEIGHT) * logit(clamp(F.col("confidence"), *MERGE_CLIP))).alias("odds"),
        F.countDistinct("source").alias("sources"),
        F.max(F.col("confidence") * literal_map(weights, F.col("source"), MERGE_WEIGHT)).alias("damped"),
        F.min("ord").alias("ord"),
    )
    exact = F.col("sources") >= 2
    w = Window.partitionBy("symbol").orderBy(exact.desc(), F.when(exact, F.col("ord")).asc_nulls_last(), F.desc("damped"), "ord")
    confidence = F.when(exact, clamp(sigmoid(clamp(F.col("odds"), -20.0, 20.0)), *MERGE_CLIP)).otherwise(F.col("damped"))
    best = per.withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    return best.select("symbol", "name", confidence.alias("confidence"), F.when(exact, "exact_multi").otherwise("single").alias("method")).filter(F.col("confidence") >= drop)


def correlated_calibration(evidence: DataFrame, digits: int = 4) -> DataFrame:
    """function, algorithm, n_methods, negatives, consistency, confidence of evidence(function, algorithm, method, confidence, negatives, consistency).

    Methods constant, structural and api miss together more often than by chance: correlation terms .30, .10 and .20 add to the
    product of misses. One method is capped at .94, structure alone at .50; each negative takes .85, consistency adds up to .15.
    """
    best = lambda m: F.coalesce(F.max(F.when(F.col("method") == m, F.col("confidence"))), F.lit(0.0))
    per = evidence.groupBy("function", "algorithm").agg(
        best("constant").alias("c"), best("structural").alias("s"), best("api").alias("a"), F.countDistinct("method").alias("n_methods"), F.max("negatives").alias("negatives"), F.max("consistency").alias("consistency")
    )
    c, s, a = F.col("c"), F.col("s"), F.col("a")
    both = lambda x, y: F.sqrt(F.greatest(x * (1 - x) * y * (1 - y), F.lit(1e-10)))
    miss = (1 - c) * (1 - s) * (1 - a) + 0.30 * both(c, s) + 0.10 * both(c, a) + 0.20 * both(s, a)
    p = 1 - miss
    p = F.when((c == 0) & (a == 0), F.least(p, F.lit(0.50))).otherwise(F.when(F.col("n_methods") == 1, F.least(p, F.lit(0.94))).otherwise(p))
    p = p * F.pow(F.lit(0.85), F.col("negatives")) * (1 + 0.15 * F.col("consistency"))
    return per.select("function", "algorithm", "n_methods", "negatives", "consistency", F.bround(clamp(p, 0.01, 0.995), digits).alias("confidence"))


def tier() -> Column:
    """Of confidence, n_methods, negatives, consistency."""
    conf, neg = F.col("confidence"), F.col("negatives")
    confirmed = (conf >= 0.995) & (F.col("n_methods") >= 2) & (neg == 0) & (F.col("consistency") >= 0.3)
    return F.when(confirmed, "CONFIRMED").when((conf >= 0.85) & (neg <= 1), "HIGH").when(conf >= 0.50, "MEDIUM").otherwise("LOW")


def group_boost(matches: DataFrame, min_group: int = 2, first: float = 0.15, extra: float = 0.05, most_extra: int = 4, cap: float = 0.90) -> DataFrame:
    """algorithm, category, confidence, group_n: the best match of each, raised by its category's number of hits."""
    per = matches.groupBy("algorithm", "category").agg(F.max("confidence").alias("best"), F.count(F.lit(1)).alias("hits"))
    n = F.sum("hits").over(Window.partitionBy("category"))
    boost = F.when(n >= min_group, first + extra * F.least(n - min_group, F.lit(most_extra))).otherwise(0.0)
    out = per.select("algorithm", "category", F.least(F.col("best") + boost, F.lit(cap)).alias("confidence"), n.alias("group_n"))
    return out.filter("confidence > 0")


def domain_distribution(matches: DataFrame, least: float = 0.001, digits: int = 4) -> DataFrame:
    """function, domain, share: confidences of a function's domains as parts of one."""
    per = matches.groupBy("function", "domain").agg(F.sum("confidence").alias("s"))
    share = F.col("s") / F.sum("s").over(Window.partitionBy("function"))
    return per.select("function", "domain", share.alias("share")).filter(F.col("share") > least).withColumn("share", F.bround("share", digits))


def domain_classify(hits: DataFrame, priority: Sequence[str], margin: float = 0.10, name_hint: float = 0.3, string_hint: float = 0.2) -> DataFrame:
    """function, domain, score: category weights plus name hints and distinct string hints (up to 1), normalised; within the margin the domain of higher priority wins."""
    per = hits.groupBy("function", "domain").agg((F.sum("weight") + name_hint * F.max("name_hit") + F.least(string_hint * F.countDistinct("string_hit"), F.lit(1.0))).alias("raw"))
    fn = Window.partitionBy("function")
    scored = per.withColumn("score", F.col("raw") / F.sum("raw").over(fn))
    rank = literal_map({d: float(i) for i, d in enumerate(priority)}, F.col("domain"), float(len(priority)))
    near = scored.filter(F.col("raw") > 0).withColumn("top", F.max("score").over(fn)).filter(F.col("score") >= F.col("top") - margin)
    w = fn.orderBy(rank, F.desc("score"), "domain")
    return near.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("function", "domain", "score")


def expected_overlap(found: DataFrame, expected: DataFrame) -> DataFrame:
    """function, algorithm, consistency: the part of expected(algorithm, callee) names among found(function, algorithm, callee), equal or one in the other."""
    total = expected.groupBy("algorithm").agg(F.countDistinct("callee").alias("total"))
    e = expected.select(F.col("algorithm").alias("ea"), F.lower("callee").alias("ec"))
    hit = F.col("callee").contains(F.col("ec")) | F.col("ec").contains(F.col("callee"))
    low = found.select("function", "algorithm", F.lower("callee").alias("callee")).distinct()
    met = low.join(e, (F.col("algorithm") == F.col("ea")) & hit).groupBy("function", "algorithm").agg(F.countDistinct("ec").alias("hits"))
    every = found.select("function", "algorithm").distinct().join(total, "algorithm")
    return every.join(met, ["function", "algorithm"], "left").select("function", "algorithm", (F.coalesce("hits", F.lit(0)) / F.col("total")).alias("consistency"))


def negative_evidence(bodies: DataFrame, forbidden: Sequence[str]) -> DataFrame:
    """func_id, negatives: how many forbidden strings a body holds."""
    hits = [F.when(F.col("code").contains(f), 1).otherwise(0) for f in forbidden]
    return bodies.select("func_id", sum(hits[1:], hits[0]).cast("long").alias("negatives"))


def selectivity_filter(matches: DataFrame, digest: str = "signature", discard: int = 20, threshold: float = 0.5) -> DataFrame:
    """matches(signature, sig_len, confidence, ...) whose signature isn't too common: over `discard` uses it goes, over max(2, sig_len / 8) its confidence is halved before the threshold."""
    uses = matches.groupBy(digest).agg(F.count(F.lit(1)).alias("uses")).withColumnRenamed(digest, "__d")
    joined = matches.join(uses, F.col(digest) == F.col("__d")).drop("__d").filter(F.col("uses") <= discard)
    many = F.col("uses") > F.greatest(F.lit(2), F.floor(F.col("sig_len") / 8))
    return joined.withColumn("confidence", F.when(many, F.col("confidence") * 0.5).otherwise(F.col("confidence"))).filter(F.col("confidence") >= threshold)


def keep_best(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def dedup_matches(matches: DataFrame) -> DataFrame:
    """function, algorithm, confidence, evidence: the highest confidence, with the evidence of all rows that have it."""
    top = matches.withColumn("top", F.max("confidence").over(Window.partitionBy("function", "algorithm"))).filter("confidence = top")
    return top.groupBy("function", "algorithm").agg(F.max("confidence").alias("confidence"), F.array_join(F.array_sort(F.collect_set("evidence")), ",").alias("evidence"))


def xref_boost(scored: DataFrame, edges: DataFrame, generic: Sequence[str] = (), cap: float = 0.98) -> DataFrame:
    """scored(symbol, name, confidence) raised by the number of references to the symbol: over 20 x1.1, 50 x1.2, 100 x1.3."""
    refs = edges.groupBy(F.col("dst").alias("__s")).agg(F.count(F.lit(1)).alias("xrefs"))
    n = F.coalesce("xrefs", F.lit(0))
    factor = F.when(F.col("name").isin(*generic), 1.0).when(n > 100, 1.3).when(n > 50, 1.2).when(n > 20, 1.1).otherwise(1.0)
    joined = scored.join(refs, F.col("symbol") == F.col("__s"), "left")
    return joined.select("symbol", "name", n.cast("long").alias("xrefs"), F.when(factor > 1, F.least(F.col("confidence") * factor, F.lit(cap))).otherwise(F.col("confidence")).alias("confidence"))
