"""Metric queries: part rows as naming results, labels and text measures as scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evisim.operators import metrics as mt


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_KIND = "CASE p_partkey % 11 WHEN 0 THEN 'wrong' WHEN 1 THEN 'missing' WHEN 2 THEN 'preserved' WHEN 3 THEN 'partial' WHEN 4 THEN 'semantic' ELSE 'exact' END"


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").selectExpr("p_brand AS source", f"{_KIND} AS kind")


_PRF = f"""WITH m AS (SELECT p_brand AS source, {_KIND} AS kind FROM part), r AS (SELECT * FROM m WHERE kind <> 'preserved'),
g AS (SELECT {{by}} count(*) FILTER (kind IN ('exact', 'semantic', 'partial')) AS tp, count(*) FILTER (kind = 'wrong') AS fp, count(*) FILTER (kind = 'missing') AS fn, sum(CASE kind WHEN 'exact' THEN 1.0 WHEN 'semantic' THEN 0.8 WHEN 'partial' THEN 0.5 ELSE 0 END::DOUBLE) AS w, count(*) AS n FROM r {{group}})
SELECT {{by}} tp, fp, fn, round_even(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round_even(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall, round_even(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1, round_even(w / n, 6) AS accuracy FROM g"""


def prf_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.prf(_matches(spark, sf_dir), "source")


def prf_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.prf(_matches(spark, sf_dir))


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.confusion(_t(spark, sf_dir, "part").selectExpr("p_type AS actual", "substr(p_brand, 7, 1) AS predicted"), "actual", "predicted")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id").selectExpr("doc_id", "(doc_id * 7919 % 1000) / 1000.0D AS prob", "quality AS correct", "toxic")


_SCORED = "WITH s AS (SELECT doc_id, (doc_id * 7919 % 1000) / 1000.0::DOUBLE AS prob, quality AS correct, toxic FROM documents JOIN labels USING (doc_id)) "
COVERAGES = [0.1, 0.25, 0.5, 0.75, 1.0]


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.precision_at_coverage(_scored(spark, sf_dir), COVERAGES, [F.desc("prob")])


_COVERAGE = _SCORED + """, p AS (SELECT prob, count(*) AS n, sum(correct) AS c FROM s GROUP BY 1), u AS (SELECT *, sum(n) OVER w AS cn, sum(c) OVER w AS cc FROM p WINDOW w AS (ORDER BY prob DESC ROWS UNBOUNDED PRECEDING)),
k AS (SELECT coverage, greatest(1, round_even(coverage * (SELECT count(*) FROM s), 0))::BIGINT AS k FROM (SELECT unnest([0.1, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS coverage))
SELECT coverage, k, round_even((cc - c + (k - (cn - n)) * c / n) / k, 6) AS precision FROM u JOIN k ON cn >= k AND cn - n < k"""


def accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.accept_stats(_scored(spark, sf_dir))


_ACCEPT = _SCORED + "SELECT count(*) AS n, count(*) FILTER (prob >= 0.90) AS accepted, count(*) FILTER (prob <= 0.30) AS rejected, count(*) FILTER (prob < 0.90 AND prob > 0.30) AS abstained, round_even(CASE WHEN count(*) FILTER (prob >= 0.90) = 0 THEN 0 ELSE count(*) FILTER (prob >= 0.90 AND correct = 1) / count(*) FILTER (prob >= 0.90) END, 6) AS precision FROM s"


def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    base = part.groupBy(F.col("p_brand").alias("metric")).agg(F.avg("p_size").alias("value"))
    now = part.filter("p_partkey % 4 <> 0").groupBy(F.col("p_brand").alias("metric")).agg(F.avg("p_size").alias("value"))
    return mt.regression_gate(now, base.filter("metric <> 'Brand#11'")).withColumns({c: F.bround(c, 6) for c in ("baseline", "current")})


_GATE = """WITH b AS (SELECT p_brand AS metric, avg(p_size) AS base FROM part WHERE p_brand <> 'Brand#11' GROUP BY 1), c AS (SELECT p_brand AS metric, avg(p_size) AS value FROM part WHERE p_partkey % 4 <> 0 GROUP BY 1)
SELECT metric, round_even(base, 6) AS baseline, round_even(value, 6) AS current, round_even((value - base) / base, 6) AS change, CASE WHEN base IS NULL THEN 'new' WHEN base = 0 THEN 'ok' WHEN round_even((base - value) / base, 9) >= 0.10 THEN 'fail' WHEN round_even((base - value) / base, 9) >= 0.05 THEN 'warn' ELSE 'ok' END AS status FROM c LEFT JOIN b USING (metric)"""


def types(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    return mt.type_precision(part.filter("p_partkey % 5 <> 0").selectExpr("p_partkey AS key", "CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE p_type END AS type"), part.filter("p_partkey % 7 <> 0").selectExpr("p_partkey AS key", "p_type AS type"))


_TYPES = """WITH p AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE p_type END AS p FROM part WHERE p_partkey % 5 <> 0), t AS (SELECT p_partkey AS key, p_type AS t FROM part WHERE p_partkey % 7 <> 0),
g AS (SELECT count(*) FILTER (p = t) AS tp, count(*) FILTER (p IS NOT NULL AND p IS DISTINCT FROM t) AS fp, count(t) AS truth FROM p FULL JOIN t USING (key)) SELECT tp, fp, round_even(tp / (tp + fp), 6) AS precision, round_even(tp / truth, 6) AS recall FROM g"""


def platt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of a calibration of text length against toxicity."""
    scored = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id").selectExpr("n_chars / 10000.0D AS score", "toxic AS label")
    a, b = mt.platt_fit(scored, iterations=25)
    return spark.createDataFrame([(round(a, 6), round(b, 6))], "a double, b double")


def placeholder_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "part").selectExpr("CASE WHEN p_partkey % 6 = 0 THEN concat('FUN_00', p_partkey) WHEN p_partkey % 6 = 1 THEN concat('param_', p_size) ELSE p_name END AS name")
    from evisim.functions.exprs import auto_name, auto_variable

    return rows.agg(F.bround(F.avg((auto_name(F.col("name")) | auto_variable(F.col("name"))).cast("double")) * 100, 6).alias("residue"))


QUERIES = {
    "prf_by_source": (prf_source, _PRF.format(by="source,", group="GROUP BY source")),
    "prf_overall": (prf_all, _PRF.format(by="", group="")),
    "confusion_matrix": (confusion, "SELECT p_type AS actual, substr(p_brand, 7, 1) AS predicted, count(*) AS n FROM part GROUP BY ALL"),
    "precision_at_coverage": (coverage, _COVERAGE),
    "accept_stats": (accept, _ACCEPT),
    "regression_gate": (gate, _GATE),
    "type_precision": (types, _TYPES),
    "platt_calibration": (platt, None),
    "placeholder_residue": (placeholder_residue, "SELECT round_even(avg((p_partkey % 6 IN (0, 1))::INT) * 100, 6) AS residue FROM part"),
}
