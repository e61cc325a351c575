"""Evidence queries over lineitem: a part's rows are the evidence of a symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evisim.operators import evidence as ev

#: A confidence in (0, 1) from a lineitem row.
CONF = "0.0513D + l_discount * 8.371D + l_quantity / 857.0D"
CONF_SQL = "0.0513::DOUBLE + l_discount * 8.371::DOUBLE + l_quantity / 857.0::DOUBLE"
WEIGHTS = {"s0": 0.9, "s1": 0.8, "s2": 0.6, "s3": 0.75}
_W_SQL = "CASE source WHEN 's0' THEN 0.9 WHEN 's1' THEN 0.8 WHEN 's2' THEN 0.6 WHEN 's3' THEN 0.75 ELSE 0.7 END::DOUBLE"
_CLIP = "least(greatest(confidence, 0.01::DOUBLE), 0.99::DOUBLE)"
_LOGIT = f"ln({_CLIP} / (1 - {_CLIP}))"


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lineitem(spark, sf_dir).selectExpr("l_partkey AS function", "l_returnflag AS name", "CASE l_suppkey % 3 WHEN 0 THEN 'structural' WHEN 1 THEN 'constant' ELSE 'api' END AS method", f"{CONF} AS confidence")


_E = f"WITH e AS (SELECT l_partkey AS function, l_returnflag AS name, CASE l_suppkey % 3 WHEN 0 THEN 'structural' WHEN 1 THEN 'constant' ELSE 'api' END AS method, {CONF_SQL} AS confidence FROM lineitem) "


def noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.noisy_or(_evidence(spark, sf_dir), digits=6)


_NOISY = _E + """, g AS (SELECT function, lower(trim(name)) AS name, count(*) AS n, max(confidence) AS top, 1 - product(1 - confidence) AS p, list_sort(list(DISTINCT method)) AS m FROM e GROUP BY ALL),
c AS (SELECT *, CASE WHEN len(m) = 1 AND m[1] = 'structural' THEN least(p, 0.50::DOUBLE) ELSE p END AS p1 FROM g),
d AS (SELECT *, CASE WHEN p1 >= 0.70 AND len(m) < 2 AND NOT list_contains(m, 'api') THEN 0.69::DOUBLE ELSE p1 END AS p2 FROM c)
SELECT function, name, round_even(CASE WHEN n = 1 THEN top ELSE least(p2, 0.98::DOUBLE) END, 6) AS confidence, array_to_string(m, '+') AS methods, n FROM d"""


def _masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = "CASE l_suppkey % 5 WHEN 0 THEN 'signature' WHEN 1 THEN 'string' WHEN 2 THEN 'api' WHEN 3 THEN 'callgraph' ELSE 'engineering' END AS kind"
    rows = _lineitem(spark, sf_dir).selectExpr("l_partkey AS symbol", "l_returnflag AS hypothesis", "concat('s', l_suppkey % 4) AS source", kinds, f"{CONF} AS quality", "l_linenumber AS hits")
    return ev.belief_mass(rows)


_MASS = f"""WITH r AS (SELECT l_partkey AS symbol, l_returnflag AS hypothesis, 's' || l_suppkey % 4 AS source,
CASE l_suppkey % 5 WHEN 0 THEN 'signature' WHEN 1 THEN 'string' WHEN 2 THEN 'api' WHEN 3 THEN 'callgraph' ELSE 'engineering' END AS kind, {CONF_SQL} AS quality, l_linenumber AS hits FROM lineitem),
m AS (SELECT *, least(CASE kind WHEN 'signature' THEN 0.55 WHEN 'string' THEN 0.65 WHEN 'api' THEN 0.80 WHEN 'callgraph' THEN 0.60 ELSE 0.50 END::DOUBLE
  * CASE WHEN kind = 'engineering' THEN least(0.3::DOUBLE + 0.15::DOUBLE * hits, 0.9::DOUBLE) ELSE quality END, 0.95::DOUBLE) AS mass FROM r) """


def belief_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masses(spark, sf_dir).groupBy("symbol", "kind").agg(F.bround(F.sum("mass"), 6).alias("mass"), F.count(F.lit(1)).alias("n"))


def dempster_shafer(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ev.dempster_shafer(_masses(spark, sf_dir).withColumn("mass", F.col("mass") * 0.3))
    return out.withColumns({"belief": F.bround("belief", 6), "conflict": F.bround("conflict", 6)})


_DS = _MASS + """, p AS (SELECT symbol, hypothesis, least(1 - product(1 - mass * 0.3::DOUBLE), 0.98::DOUBLE) AS belief, count(DISTINCT source) AS agreement FROM m GROUP BY ALL),
w AS (SELECT *, lead(belief) OVER v AS second, row_number() OVER v AS rn FROM p WINDOW v AS (PARTITION BY symbol ORDER BY belief DESC, hypothesis))
SELECT symbol, hypothesis, round_even(belief, 6) AS belief, agreement, round_even(coalesce(second / belief, 0), 6) AS conflict FROM w WHERE rn = 1"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lineitem(spark, sf_dir).selectExpr("l_partkey AS symbol", "l_returnflag AS name", "concat('s', l_suppkey % 5) AS source", f"{CONF} AS confidence", "l_orderkey * 10 + l_linenumber AS ord")


_C = f"WITH c AS (SELECT l_partkey AS symbol, l_returnflag AS name, 's' || l_suppkey % 5 AS source, {CONF_SQL} AS confidence, l_orderkey * 10 + l_linenumber AS ord FROM lineitem) "


def log_odds_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.log_odds_merge(_candidates(spark, sf_dir), WEIGHTS).withColumn("confidence", F.bround("confidence", 6))


_LOG_ODDS = _C + f"""SELECT symbol, name, round_even(least(greatest(1 / (1 + exp(-least(greatest(sum({_W_SQL} * {_LOGIT}), -20), 20))), 0.01::DOUBLE), 0.99::DOUBLE), 6) AS confidence, count(*) AS n FROM c GROUP BY ALL"""


def merge_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.merge_decision(_candidates(spark, sf_dir), WEIGHTS).withColumn("confidence", F.bround("confidence", 6))


_MERGE = _C + f""", g AS (SELECT symbol, name, sum({_W_SQL} * {_LOGIT}) AS odds, count(DISTINCT source) AS sources, max(confidence * {_W_SQL}) AS damped, min(ord) AS ord FROM c GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY sources >= 2 DESC, CASE WHEN sources >= 2 THEN ord END NULLS LAST, damped DESC, ord) AS rn FROM g),
d AS (SELECT symbol, name, CASE WHEN sources >= 2 THEN least(greatest(1 / (1 + exp(-least(greatest(odds, -20), 20))), 0.01::DOUBLE), 0.99::DOUBLE) ELSE damped END AS confidence, CASE WHEN sources >= 2 THEN 'exact_multi' ELSE 'single' END AS method FROM w WHERE rn = 1)
SELECT symbol, name, round_even(confidence, 6) AS confidence, method FROM d WHERE confidence >= 0.30"""


def _calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _evidence(spark, sf_dir).withColumnRenamed("name", "algorithm").withColumns({"negatives": F.expr("CAST(function % 4 = 1 AS INT) + CAST(function % 9 = 2 AS INT)"), "consistency": F.expr("(function % 5) / 5.0D")})
    return ev.correlated_calibration(rows, digits=6)


_CAL = _E + """, g AS (SELECT function, name AS algorithm, coalesce(max(confidence) FILTER (method = 'constant'), 0) AS c, coalesce(max(confidence) FILTER (method = 'structural'), 0) AS s, coalesce(max(confidence) FILTER (method = 'api'), 0) AS a,
 count(DISTINCT method) AS n_methods, (function % 4 = 1)::INT + (function % 9 = 2)::INT AS negatives, (function % 5) / 5.0::DOUBLE AS consistency FROM e GROUP BY function, name),
p AS (SELECT *, 1 - ((1 - c) * (1 - s) * (1 - a) + 0.30::DOUBLE * sqrt(greatest(c * (1 - c) * s * (1 - s), 1e-10)) + 0.10::DOUBLE * sqrt(greatest(c * (1 - c) * a * (1 - a), 1e-10)) + 0.20::DOUBLE * sqrt(greatest(s * (1 - s) * a * (1 - a), 1e-10))) AS p0 FROM g),
q AS (SELECT *, CASE WHEN c = 0 AND a = 0 THEN least(p0, 0.50::DOUBLE) WHEN n_methods = 1 THEN least(p0, 0.94::DOUBLE) ELSE p0 END AS p1 FROM p),
cal AS (SELECT function, algorithm, n_methods, negatives, consistency, round_even(least(greatest(p1 * pow(0.85::DOUBLE, negatives) * (1 + 0.15::DOUBLE * consistency), 0.01::DOUBLE), 0.995::DOUBLE), 6) AS confidence FROM q) """


def correlated_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibrated(spark, sf_dir)


def confidence_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibrated(spark, sf_dir).groupBy(ev.tier().alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg("confidence"), 6).alias("mean"))


_TIERS = _CAL + """SELECT CASE WHEN confidence >= 0.995 AND n_methods >= 2 AND negatives = 0 AND consistency >= 0.3 THEN 'CONFIRMED' WHEN confidence >= 0.85 AND negatives <= 1 THEN 'HIGH' WHEN confidence >= 0.50 THEN 'MEDIUM' ELSE 'LOW' END AS tier,
 count(*) AS n, round_even(avg(confidence), 6) AS mean FROM cal GROUP BY 1"""


def group_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lineitem(spark, sf_dir).selectExpr("l_partkey AS algorithm", "concat('c', l_partkey % 700) AS category", f"({CONF}) * 0.6D AS confidence")
    return ev.group_boost(rows).withColumn("confidence", F.bround("confidence", 6))


_BOOST = f"""WITH g AS (SELECT l_partkey AS algorithm, 'c' || l_partkey % 700 AS category, max(({CONF_SQL}) * 0.6::DOUBLE) AS best, count(*) AS hits FROM lineitem GROUP BY ALL),
s AS (SELECT *, (sum(hits) OVER (PARTITION BY category))::BIGINT AS n FROM g)
SELECT algorithm, category, round_even(least(best + CASE WHEN n >= 2 THEN 0.15::DOUBLE + 0.05::DOUBLE * least(n - 2, 4) ELSE 0 END, 0.90::DOUBLE), 6) AS confidence, n AS group_n FROM s"""


def domain_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.domain_distribution(_evidence(spark, sf_dir).withColumnRenamed("name", "domain"), digits=6)


_DOMAIN = _E + """, s AS (SELECT function, name AS domain, sum(confidence) AS s FROM e GROUP BY ALL), p AS (SELECT function, domain, s / sum(s) OVER (PARTITION BY function) AS share FROM s)
SELECT function, domain, round_even(share, 6) AS share FROM p WHERE share > 0.001"""


def domain_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lineitem(spark, sf_dir).selectExpr("l_partkey AS function", "l_returnflag AS domain", f"{CONF} AS weight", "CAST(l_suppkey % 7 = 0 AS INT) AS name_hit", "CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey % 11 END AS string_hit")
    return ev.domain_classify(rows, ("R", "A", "N")).withColumn("score", F.bround("score", 6))


_CLASSIFY = f"""WITH g AS (SELECT l_partkey AS function, l_returnflag AS domain, sum({CONF_SQL}) + 0.3::DOUBLE * max((l_suppkey % 7 = 0)::INT) + least(0.2::DOUBLE * count(DISTINCT CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey % 11 END), 1) AS raw FROM lineitem GROUP BY ALL),
s AS (SELECT *, raw / sum(raw) OVER (PARTITION BY function) AS score FROM g),
t AS (SELECT *, max(score) OVER (PARTITION BY function) AS top FROM s),
w AS (SELECT *, row_number() OVER (PARTITION BY function ORDER BY CASE domain WHEN 'R' THEN 0 WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END, score DESC, domain) AS rn FROM t WHERE score >= top - 0.10)
SELECT function, domain, round_even(score, 6) AS score FROM w WHERE rn = 1"""


def call_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey % 400 AS function", "p_brand AS algorithm", "p_name AS callee")
    words = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_brand AS algorithm", "split(p_name, ' ')[0] AS callee").distinct()
    return ev.expected_overlap(part, words).withColumn("consistency", F.bround("consistency", 6))


_CONSISTENCY = """WITH f AS (SELECT DISTINCT p_partkey % 400 AS function, p_brand AS algorithm, lower(p_name) AS callee FROM part),
x AS (SELECT DISTINCT p_brand AS algorithm, split_part(p_name, ' ', 1) AS callee FROM part), t AS (SELECT algorithm, count(DISTINCT callee) AS total FROM x GROUP BY 1),
h AS (SELECT function, f.algorithm, count(DISTINCT lower(x.callee)) AS hits FROM f JOIN x ON f.algorithm = x.algorithm AND (contains(f.callee, lower(x.callee)) OR contains(lower(x.callee), f.callee)) GROUP BY ALL)
SELECT a.function, a.algorithm, round_even(coalesce(hits, 0)::DOUBLE / total, 6) AS consistency FROM (SELECT DISTINCT function, algorithm FROM f) a JOIN t USING (algorithm) LEFT JOIN h USING (function, algorithm)"""


def negative_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id AS func_id", "text AS code")
    return ev.negative_evidence(docs, ["!!", "&&&", "@", "License", " | "])


def selectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lineitem(spark, sf_dir).selectExpr("concat(l_partkey, '/', l_suppkey % 4) AS signature", "l_partkey % 60 AS sig_len", f"{CONF} AS confidence", "l_orderkey", "l_linenumber")
    return ev.selectivity_filter(rows).select("signature", "l_orderkey", "l_linenumber", "uses", F.bround("confidence", 6).alias("confidence"))


_SELECT = f"""WITH m AS (SELECT l_partkey || '/' || l_suppkey % 4 AS signature, l_partkey % 60 AS sig_len, {CONF_SQL} AS confidence, l_orderkey, l_linenumber FROM lineitem),
u AS (SELECT *, count(*) OVER (PARTITION BY signature) AS uses FROM m),
c AS (SELECT signature, l_orderkey, l_linenumber, uses, CASE WHEN uses > greatest(2, sig_len // 8) THEN confidence * 0.5 ELSE confidence END AS confidence FROM u WHERE uses <= 20)
SELECT signature, l_orderkey, l_linenumber, uses, round_even(confidence, 6) AS confidence FROM c WHERE confidence >= 0.5"""


def edge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lineitem(spark, sf_dir).selectExpr("l_suppkey AS src", "l_partkey AS dst", "l_returnflag AS flow", f"{CONF} AS confidence")
    return rows.groupBy("src", "dst", "flow").agg(F.bround(F.max("confidence"), 6).alias("confidence"), F.count(F.lit(1)).alias("n"))


def best_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir)
    best = ev.keep_best(rows, ["symbol"], [F.desc("confidence"), F.asc("name"), F.asc("source"), F.asc("ord")])
    return best.select("symbol", "name", "source", F.bround("confidence", 6).alias("confidence"))


def dedup_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lineitem(spark, sf_dir).selectExpr("l_partkey AS function", "l_returnflag AS algorithm", "l_discount AS confidence", "concat('s', l_suppkey) AS evidence")
    return ev.dedup_matches(rows)


def xref_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS symbol", "p_name AS name", "p_size / 57.0D AS confidence")
    edges = _lineitem(spark, sf_dir).selectExpr("l_suppkey AS src", "l_partkey AS dst")
    return ev.xref_boost(scored, edges, ["red widget"]).withColumn("confidence", F.bround("confidence", 6))


_XREF = """WITH r AS (SELECT l_partkey AS s, count(*) AS n FROM lineitem GROUP BY 1),
j AS (SELECT p_partkey AS symbol, p_name AS name, p_size / 57.0::DOUBLE AS c, coalesce(n, 0) AS xrefs FROM part LEFT JOIN r ON p_partkey = s),
f AS (SELECT *, CASE WHEN name = 'red widget' THEN 1.0 WHEN xrefs > 100 THEN 1.3 WHEN xrefs > 50 THEN 1.2 WHEN xrefs > 20 THEN 1.1 ELSE 1.0 END::DOUBLE AS k FROM j)
SELECT symbol, name, xrefs, round_even(CASE WHEN k > 1 THEN least(c * k, 0.98::DOUBLE) ELSE c END, 6) AS confidence FROM f"""

QUERIES = {
    "noisy_or_fusion": (noisy_or, _NOISY),
    "belief_mass": (belief_mass, _MASS + "SELECT symbol, kind, round_even(sum(mass), 6) AS mass, count(*) AS n FROM m GROUP BY ALL"),
    "ds_fusion": (dempster_shafer, _DS),
    "log_odds_merge": (log_odds_merge, _LOG_ODDS),
    "name_merge_decision": (merge_decision, _MERGE),
    "correlated_calibration": (correlated_calibration, _CAL + "SELECT * FROM cal"),
    "confidence_tiers": (confidence_tiers, _TIERS),
    "group_boost": (group_boost, _BOOST),
    "domain_distribution": (domain_distribution, _DOMAIN),
    "domain_classify": (domain_classify, _CLASSIFY),
    "call_consistency": (call_consistency, _CONSISTENCY),
    "negative_evidence": (negative_evidence, "SELECT doc_id AS func_id, (contains(text, '!!')::INT + contains(text, '&&&')::INT + contains(text, '@')::INT + contains(text, 'License')::INT + contains(text, ' | ')::INT)::BIGINT AS negatives FROM documents"),
    "selectivity_filter": (selectivity, _SELECT),
    "edge_dedup_max": (edge_dedup, f"SELECT l_suppkey AS src, l_partkey AS dst, l_returnflag AS flow, round_even(max({CONF_SQL}), 6) AS confidence, count(*) AS n FROM lineitem GROUP BY ALL"),
    "best_name_transfer": (best_name, _C + "SELECT symbol, name, source, round_even(confidence, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY confidence DESC, name, source, ord) AS rn FROM c) WHERE rn = 1"),
    "dedup_matches": (dedup_matches, "WITH m AS (SELECT l_partkey AS function, l_returnflag AS algorithm, l_discount AS confidence, 's' || l_suppkey AS evidence FROM lineitem), t AS (SELECT *, max(confidence) OVER (PARTITION BY function, algorithm) AS top FROM m) SELECT function, algorithm, max(confidence) AS confidence, array_to_string(list_sort(list(DISTINCT evidence)), ',') AS evidence FROM t WHERE confidence = top GROUP BY ALL"),
    "xref_boost": (xref_boost, _XREF),
}
