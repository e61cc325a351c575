"""Accuracy, calibration and gate metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from evisim.functions.exprs import sigmoid


def prf(matches: DataFrame, by: str | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall, f1, accuracy of matches(kind: exact, semantic, partial, wrong, missing, preserved); preserved rows don't count. Kinds weigh 1, .8, .5."""
    rows = matches.filter("kind <> 'preserved'")
    n = lambda *k: F.count_if(F.col("kind").isin(*k))
    g = (rows.groupBy(by) if by else rows.groupBy()).agg(n("exact", "semantic", "partial").alias("tp"), n("wrong").alias("fp"), n("missing").alias("fn"), F.sum(F.when(F.col("kind") == "exact", 1.0).when(F.col("kind") == "semantic", 0.8).when(F.col("kind") == "partial", 0.5).otherwise(0.0)).alias("w"), F.count(F.lit(1)).alias("n"))
    div = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    r = lambda c: F.bround(c, 6)
    return g.select(*([by] if by else []), "tp", "fp", "fn", r(div(tp, tp + fp)).alias("precision"), r(div(tp, tp + fn)).alias("recall"), r(div(2 * tp, 2 * tp + fp + fn)).alias("f1"), r(div(F.col("w"), F.col("n"))).alias("accuracy"))


def confusion(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    return rows.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))


def precision_at_coverage(scored: DataFrame, coverages: list[float], order: list[Column]) -> DataFrame:
    """coverage, k, precision of scored(prob, correct): the first max(1, round_half_even(coverage * n)) rows by falling probability.

    Rows are counted by probability before they are ranked, so one task orders distinct probabilities, not rows; where k falls
    among equal probabilities, their mean counts.
    """
    per = scored.groupBy("prob").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("double")).alias("c"))
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cum = per.select("prob", "n", "c", F.sum("n").over(w).alias("cn"), F.sum("c").over(w).alias("cc"))
    total = scored.agg(F.count(F.lit(1)).alias("total"))
    ks = total.select(F.explode(F.array(*[F.lit(float(c)) for c in coverages])).alias("coverage"), "total").select("coverage", F.greatest(F.lit(1), F.bround(F.col("coverage") * F.col("total"), 0).cast("long")).alias("k"))
    hit = cum.crossJoin(F.broadcast(ks)).filter((F.col("cn") >= F.col("k")) & (F.col("cn") - F.col("n") < F.col("k")))
    return hit.select("coverage", "k", F.bround((F.col("cc") - F.col("c") + (F.col("k") - (F.col("cn") - F.col("n"))) * F.col("c") / F.col("n")) / F.col("k"), 6).alias("precision"))


def accept_stats(scored: DataFrame, accept: float = 0.90, reject: float = 0.30) -> DataFrame:
    """n, accepted, rejected, abstained, precision of what is accepted; both bounds count as inside."""
    a, r = F.col("prob") >= accept, F.col("prob") <= reject
    g = scored.agg(F.count(F.lit(1)).alias("n"), F.count_if(a).alias("accepted"), F.count_if(~a & r).alias("rejected"), F.count_if(~a & ~r).alias("abstained"), F.count_if(a & (F.col("correct") == 1)).alias("hits"))
    return g.select("n", "accepted", "rejected", "abstained", F.bround(F.when(F.col("accepted") == 0, 0.0).otherwise(F.col("hits") / F.col("accepted")), 6).alias("precision"))


def fpr_budget(prior: float, tpr: float, precision: float) -> float:
    """The false-positive rate at which that precision holds."""
    return prior * tpr * (1 - precision) / ((1 - prior) * precision)


def regression_gate(current: DataFrame, baseline: DataFrame, warn: float = 0.05, fail: float = 0.10) -> DataFrame:
    """metric, baseline, current, change, status: ok, warn or fail by the relative drop; metrics without a baseline are new."""
    j = current.join(baseline.select("metric", F.col("value").alias("base")), "metric", "left")
    drop = F.bround((F.col("base") - F.col("value")) / F.col("base"), 9)  # a drop of exactly the bound counts as one
    status = F.when(F.col("base").isNull(), "new").when(F.col("base") == 0, "ok").when(drop >= fail, "fail").when(drop >= warn, "warn").otherwise("ok")
    return j.select("metric", F.col("base").alias("baseline"), F.col("value").alias("current"), F.bround((F.col("value") - F.col("base")) / F.col("base"), 6).alias("change"), status.alias("status"))


def type_precision(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """tp, fp, precision, recall of (key, type) rows; a prediction without truth is false."""
    j = predicted.select("key", F.col("type").alias("p")).join(truth.select("key", F.col("type").alias("t")), "key", "full_outer")
    g = j.agg(F.count_if(F.col("p") == F.col("t")).alias("tp"), F.count_if(F.col("p").isNotNull() & ~F.col("p").eqNullSafe(F.col("t"))).alias("fp"), F.count("t").alias("truth"))
    tp = F.col("tp")
    return g.select("tp", "fp", F.bround(F.when(tp + F.col("fp") == 0, 0.0).otherwise(tp / (tp + F.col("fp"))), 6).alias("precision"), F.bround(F.when(F.col("truth") == 0, 0.0).otherwise(tp / F.col("truth")), 6).alias("recall"))


def platt_fit(scored: DataFrame, iterations: int = 200, rate: float = 0.05, tolerance: float = 1e-6) -> tuple[float, float]:
    """a, b of sigmoid(a * score + b) by gradient steps on smoothed targets; a step is one aggregate over distinct (score, label) counts."""
    rows = scored.groupBy("score", "label").agg(F.count(F.lit(1)).alias("n")).cache()
    n1, n0 = (float(x or 0) for x in rows.agg(F.sum(F.when(F.col("label") == 1, F.col("n"))), F.sum(F.when(F.col("label") == 0, F.col("n")))).first())
    high, low, n = (n1 + 1) / (n1 + 2), 1 / (n0 + 2), max(n1 + n0, 1.0)
    a, b = 1.0, 0.0
    try:
        for _ in range(iterations):
            err = (sigmoid(F.lit(a) * F.col("score") + F.lit(b)) - F.when(F.col("label") == 1, high).otherwise(low)) * F.col("n")
            ga, gb = (float(x or 0.0) / n for x in rows.agg(F.sum(err * F.col("score")), F.sum(err)).first())
            a, b = a - rate * ga, b - rate * gb
            if math.hypot(ga, gb) < tolerance:
                break
    finally:
        rows.unpersist()
    return a, b
