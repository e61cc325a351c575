"""Matching queries: two versions of part as function tables, orders as token sets, a heap over part keys as call graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evisim.operators import intervals, matching as m
from evisim.tables import written


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def _functions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = _part(spark, sf_dir)
    exprs = ["p_partkey AS id", "concat(p_name, ':', p_size) AS code", "CAST(floor(p_retailprice) AS INT) AS size", "p_size % 8 AS param_count", "p_brand AS return_type", "p_type AS convention", "p_partkey % 11 = 0 AS thunk", "array(p_size % 5, p_partkey % 3) AS constants"]
    return part.filter("p_partkey % 10 <> 3").selectExpr(*exprs), part.filter("p_partkey % 10 <> 7").selectExpr(*exprs)


_BASE = "SELECT p_partkey AS id, p_name || ':' || p_size AS code, floor(p_retailprice)::INT AS size, p_size % 8 AS param_count, p_brand AS return_type, p_type AS convention, p_partkey % 11 = 0 AS thunk, [p_size % 5, p_partkey % 3] AS constants FROM part"
_F = f"WITH ref AS ({_BASE} WHERE p_partkey % 10 <> 3), tgt AS ({_BASE} WHERE p_partkey % 10 <> 7) "


def hash_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, tgt = _functions(spark, sf_dir)
    code = F.sha2(F.concat_ws("|", "code", "return_type"), 256)
    return m.unique_key_match(ref.withColumn("h", code), tgt.withColumn("h", code), "h")


_UNIQUE = "r AS (SELECT {key} AS k, min(id) AS r FROM {ref} GROUP BY 1 HAVING count(*) = 1), t AS (SELECT {key} AS k, min(id) AS t, count(*) AS nt FROM {tgt} GROUP BY 1{one}) "


def fingerprint_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.fingerprint_match(*_functions(spark, sf_dir))


def quantized_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.quantized_match(*_functions(spark, sf_dir))


def _order_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li = _lineitem(spark, sf_dir).selectExpr("l_partkey AS id", "l_orderkey AS token", "l_linenumber AS n")
    return li.filter("n < 6").select("id", "token"), li.filter("n > 1").select("id", "token")


def jaccard_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = m.jaccard_match(*_order_sets(spark, sf_dir))
    return out.withColumns({"jaccard": F.bround("jaccard", 6), "confidence": F.bround("confidence", 6)})


_JACCARD = """WITH a AS (SELECT DISTINCT l_partkey AS r, l_orderkey AS k FROM lineitem WHERE l_linenumber < 6), b AS (SELECT DISTINCT l_partkey AS t, l_orderkey AS k FROM lineitem WHERE l_linenumber > 1),
na AS (SELECT r, count(*) AS nr FROM a GROUP BY 1 HAVING count(*) >= 2), nb AS (SELECT t, count(*) AS nt FROM b GROUP BY 1 HAVING count(*) >= 2),
j AS (SELECT r, t, i::DOUBLE / (nr + nt - i) AS jaccard FROM (SELECT r, t, count(*) AS i FROM a JOIN b USING (k) GROUP BY ALL) JOIN na USING (r) JOIN nb USING (t)),
f AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY jaccard DESC, t) AS n FROM j WHERE jaccard >= 0.5),
g AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY jaccard DESC, r) AS n2 FROM f WHERE n = 1)
SELECT r, t, round_even(jaccard, 6) AS jaccard, round_even(jaccard * 0.90::DOUBLE, 6) AS confidence FROM g WHERE n2 = 1"""


def size_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = m.size_tolerance_match(*_functions(spark, sf_dir), digits=6)
    return out.withColumn("score", F.bround("score", 6))


_SIZE = _F + """, p AS (SELECT a.id AS r, b.id AS t, (1 - abs(a.size - b.size)::DOUBLE / greatest(a.size, b.size)) AS sim, a.return_type = b.return_type AS same FROM ref a JOIN tgt b ON a.param_count = b.param_count AND a.size > 0 AND b.size > 0
  WHERE (1 - abs(a.size - b.size)::DOUBLE / greatest(a.size, b.size)) >= 0.90::DOUBLE),
u AS (SELECT min(id) AS r FROM ref GROUP BY size, param_count, return_type HAVING count(*) = 1),
s AS (SELECT r, t, sim * CASE WHEN same THEN 1.0 ELSE 0.8 END::DOUBLE AS score FROM p SEMI JOIN u USING (r)),
f AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, t) AS n FROM s),
g AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, r) AS n2 FROM f WHERE n = 1 AND score >= 0.85)
SELECT r, t, round_even(score, 6) AS score, round_even(score * 0.78::DOUBLE, 6) AS confidence FROM g WHERE n2 = 1"""


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A graph over part keys, its copy shifted by a million, and matches of two thirds of the keys."""
    part = _part(spark, sf_dir)
    edges = part.selectExpr("p_partkey AS src", "explode(array(2 * p_partkey, 2 * p_partkey + 1, p_partkey + 7, p_partkey + p_size)) AS dst")
    moved = edges.selectExpr("src + 1000000 AS src", "dst + 1000000 AS dst")
    matches = part.filter("p_partkey % 3 <> 0").selectExpr("p_partkey AS r", "p_partkey + 1000000 AS t")
    return edges, moved, matches


_GRAPH = """WITH e AS (SELECT p_partkey AS src, unnest([2 * p_partkey, 2 * p_partkey + 1, p_partkey + 7, p_partkey + p_size]) AS dst FROM part), e2 AS (SELECT src + 1000000 AS src, dst + 1000000 AS dst FROM e),
m AS (SELECT p_partkey AS r, p_partkey + 1000000 AS t FROM part WHERE p_partkey % 3 <> 0) """


def neighbor_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = m.neighbor_overlap_match(*_graph(spark, sf_dir), digits=6)
    return out.withColumn("score", F.bround("score", 6))


_NEIGHBOR = _GRAPH + """, a AS (SELECT DISTINCT * FROM (SELECT src AS r, dst AS rn FROM e UNION ALL SELECT dst, src FROM e) WHERE r NOT IN (SELECT r FROM m)),
b AS (SELECT DISTINCT * FROM (SELECT src AS t, dst AS tn FROM e2 UNION ALL SELECT dst, src FROM e2) WHERE t NOT IN (SELECT t FROM m)),
p AS (SELECT a.r, m.t AS mt FROM a JOIN m ON a.rn = m.r), c AS (SELECT r, count(*) AS total FROM p GROUP BY 1),
s AS (SELECT r, t, shared::DOUBLE / total AS score FROM (SELECT p.r, b.t, count(*) AS shared FROM p JOIN b ON mt = tn GROUP BY ALL) JOIN c USING (r) WHERE shared >= 2),
f AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, t) AS n FROM s WHERE score >= 0.5), g AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, r) AS n2 FROM f WHERE n = 1)
SELECT r, t, round_even(score, 6) AS score, round_even(score * 0.75::DOUBLE, 6) AS confidence FROM g WHERE n2 = 1"""


def residual_neighbor(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, moved, matches = _graph(spark, sf_dir)
    part = _part(spark, sf_dir)
    return m.residual_neighbor_match(edges, moved, matches, part.selectExpr("p_partkey AS id", "p_size AS size"), part.selectExpr("p_partkey + 1000000 AS id", "p_size + 3 AS size"))


_RESIDUAL = _GRAPH + """, a AS (SELECT src, min(dst) AS r FROM (SELECT DISTINCT src, dst FROM e WHERE dst NOT IN (SELECT r FROM m)) GROUP BY 1 HAVING count(*) = 1),
b AS (SELECT src, min(dst) AS t FROM (SELECT DISTINCT src, dst FROM e2 WHERE dst NOT IN (SELECT t FROM m)) GROUP BY 1 HAVING count(*) = 1),
p AS (SELECT DISTINCT a.r, b.t FROM m JOIN a ON m.r = a.src JOIN b ON m.t = b.src),
q AS (SELECT p.r, p.t FROM p JOIN part x ON p.r = x.p_partkey JOIN part y ON p.t = y.p_partkey + 1000000 WHERE least(x.p_size, y.p_size + 3)::DOUBLE / greatest(x.p_size, y.p_size + 3, 1) >= 0.5),
f AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY t) AS n FROM q), g AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY r) AS n2 FROM f WHERE n = 1)
SELECT r, t, 0.85::DOUBLE AS confidence FROM g WHERE n2 = 1"""


def match_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, tgt = _functions(spark, sf_dir)
    code = F.sha2(F.concat_ws("|", "code", "return_type"), 256)
    steps = [("hash", lambda a, b: m.unique_key_match(a.withColumn("h", code), b.withColumn("h", code), "h")), ("fingerprint", m.fingerprint_match), ("quantized", m.quantized_match)]
    return m.cascade(ref, tgt, steps, written)


_CASCADE = (
    _F
    + """, r1 AS (SELECT code || '|' || return_type AS k, min(id) AS r FROM ref GROUP BY 1 HAVING count(*) = 1), t1 AS (SELECT code || '|' || return_type AS k, min(id) AS t, count(*) AS nt FROM tgt GROUP BY 1),
s1 AS (SELECT r, t, CASE WHEN nt = 1 THEN 0.95 ELSE 0.80 END::DOUBLE AS confidence FROM r1 JOIN t1 USING (k)),
ref2 AS (SELECT * FROM ref WHERE id NOT IN (SELECT r FROM s1)), tgt2 AS (SELECT * FROM tgt WHERE id NOT IN (SELECT t FROM s1)),
r2 AS (SELECT (size, param_count, return_type, convention, thunk) AS k, min(id) AS r, min(size) AS size, bool_or(thunk) AS thunk FROM ref2 GROUP BY 1 HAVING count(*) = 1), t2 AS (SELECT (size, param_count, return_type, convention, thunk) AS k, min(id) AS t FROM tgt2 GROUP BY 1 HAVING count(*) = 1),
s2 AS (SELECT * FROM (SELECT r, t, CASE WHEN thunk THEN 0.65 WHEN size < 16 THEN 0.70 WHEN size < 64 THEN 0.80 ELSE 0.85 END::DOUBLE AS confidence FROM r2 JOIN t2 USING (k)) WHERE confidence >= 0.7),
ref3 AS (SELECT * FROM ref2 WHERE id NOT IN (SELECT r FROM s2) AND size >= 64), tgt3 AS (SELECT * FROM tgt2 WHERE id NOT IN (SELECT t FROM s2) AND size >= 64),
r3 AS (SELECT ((size + 7) // 8, param_count, return_type) AS k, min(id) AS r, any_value(constants) AS ca FROM ref3 GROUP BY 1 HAVING count(*) = 1), t3 AS (SELECT ((size + 7) // 8, param_count, return_type) AS k, min(id) AS t, any_value(constants) AS cb FROM tgt3 GROUP BY 1 HAVING count(*) = 1),
s3 AS (SELECT r, t, CASE WHEN 2 * len(list_intersect(ca, cb)) >= len(list_distinct(ca || cb)) THEN 0.85 ELSE 0.80 END::DOUBLE AS confidence FROM r3 JOIN t3 USING (k))
SELECT r, t, confidence, 'hash' AS strategy FROM s1 UNION ALL SELECT r, t, confidence, 'fingerprint' FROM s2 UNION ALL SELECT r, t, confidence, 'quantized' FROM s3"""
)


def two_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part(spark, sf_dir).selectExpr("p_partkey AS id", "p_partkey % 5 AS program", "concat(p_name, '|', p_brand, '|', p_type) AS structural", "concat(p_size, '|', p_brand, '|', p_type) AS opcode")
    return m.two_key_match(rows, least=0.6)


_TWO = """WITH x AS (SELECT p_partkey AS id, p_partkey % 5 AS p, p_name || '|' || p_brand || '|' || p_type AS s, p_size || '|' || p_brand || '|' || p_type AS o FROM part),
h AS (SELECT a.id, b.id AS other, a.s = b.s AS s, a.o = b.o AS o FROM x a JOIN x b ON (a.s = b.s OR a.o = b.o) AND a.p <> b.p),
c AS (SELECT id, other, CASE WHEN s AND o THEN 1.0 WHEN s THEN 0.85 ELSE 0.65 END::DOUBLE AS similarity, CASE WHEN s AND o THEN 1.0 WHEN s THEN 0.8 ELSE 0.5 END::DOUBLE AS significance FROM h)
SELECT id, other, similarity, significance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, significance DESC, other) AS rn FROM c) WHERE rn <= 5"""


def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.suffix_duplicates(_part(spark, sf_dir).selectExpr("p_partkey AS id", "p_name AS name"))


def interval_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey % 16 AS group", "o_orderkey AS id", "o_orderkey * 10 AS start", "o_orderkey * 10 + 3 + o_orderkey % 150 AS stop")
    points = _lineitem(spark, sf_dir).selectExpr("l_orderkey % 16 AS group", "l_orderkey * 10 + l_linenumber * 20 AS p").distinct()
    return intervals.containment(points, spans)


_CONTAIN = """WITH s AS (SELECT o_orderkey % 16 AS g, o_orderkey AS id, o_orderkey * 10 AS start, o_orderkey * 10 + 3 + o_orderkey % 150 AS stop FROM orders), p AS (SELECT DISTINCT l_orderkey % 16 AS g, l_orderkey * 10 + l_linenumber * 20 AS p FROM lineitem)
SELECT p.g AS "group", p.p, s.id, s.start FROM p ASOF JOIN s ON p.g = s.g AND p.p >= s.start WHERE p.p < s.stop"""


def nearest_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _part(spark, sf_dir).selectExpr("p_partkey % 7 AS group", "p_partkey * 100 + p_size AS key")
    points = _lineitem(spark, sf_dir).selectExpr("l_partkey % 7 AS group", "l_partkey * 100 + CAST(l_quantity AS BIGINT) * 17 AS p").distinct()
    return intervals.nearest(points, keys, 350)


_NEAREST = """WITH k AS (SELECT p_partkey % 7 AS g, p_partkey * 100 + p_size AS key FROM part), p AS (SELECT DISTINCT l_partkey % 7 AS g, l_partkey * 100 + l_quantity::BIGINT * 17 AS p FROM lineitem),
a AS (SELECT p.g, p.p, k.key AS l FROM p ASOF LEFT JOIN k ON p.g = k.g AND p.p >= k.key), b AS (SELECT a.*, k.key AS r FROM a ASOF LEFT JOIN k ON a.g = k.g AND a.p <= k.key),
c AS (SELECT g AS "group", p, CASE WHEN l IS NULL THEN r WHEN r IS NULL OR p - l <= r - p THEN l ELSE r END AS key FROM b) SELECT * FROM c WHERE abs(p - key) <= 350"""


def range_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _part(spark, sf_dir).selectExpr("p_partkey * 3 AS key")
    ranges = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey AS id", "s_suppkey * 40 AS lo", "s_suppkey * 40 + 100 AS hi")
    return intervals.range_lookup(keys, ranges, 128)


def band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey * 97 AS a")
    return intervals.band_join(left, _part(spark, sf_dir).selectExpr("p_partkey * 5 AS b"), 60)


def prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_name AS key")
    probes = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("substr(c_name, 1, 14 + CAST(c_custkey % 3 AS INT)) AS prefix")
    return intervals.prefix_lookup(entries, probes)


_PREFIX = """WITH p AS (SELECT DISTINCT substr(c_name, 1, 14 + (c_custkey % 3)::INT) AS prefix FROM customer)
SELECT prefix, key FROM (SELECT prefix, c_name AS key, row_number() OVER (PARTITION BY prefix ORDER BY c_name) AS rn FROM p JOIN customer ON length(prefix) > 0 AND starts_with(c_name, prefix)) WHERE rn <= 32"""


def set_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = _part(spark, sf_dir).selectExpr("p_partkey AS id", "array(p_brand, p_type, CAST(p_size AS STRING)) AS tokens")
    probes = _part(spark, sf_dir).filter("p_partkey % 4 = 0").selectExpr("p_partkey AS probe", "array(CAST(p_size AS STRING), p_brand, p_type) AS tokens")
    return intervals.set_key_lookup(sets, probes)


def masked_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions = _part(spark, sf_dir).selectExpr("p_partkey AS id", "substr(md5(concat(p_brand, p_type)), 1, 16 + p_size % 4) AS hex")
    pats = _part(spark, sf_dir).filter("p_partkey % 5 = 0").selectExpr("p_partkey AS sig", "concat(CASE WHEN p_partkey % 20 = 0 THEN '..' ELSE substr(md5(concat(p_brand, p_type)), 1, 2) END, substr(md5(concat(p_brand, p_type)), 3, 6), '....', substr(md5(concat(p_brand, p_type)), 13, 2)) AS pattern", "14 AS low", "18 AS high", "0.5D + p_size / 200.0D AS confidence")
    return intervals.masked_pattern_match(functions, pats).withColumn("confidence", F.bround("confidence", 6))


_MASKED = """WITH f AS (SELECT p_partkey AS id, substr(md5(p_brand || p_type), 1, 16 + p_size % 4) AS hex FROM part),
p AS (SELECT p_partkey AS sig, CASE WHEN p_partkey % 20 = 0 THEN '..' ELSE substr(md5(p_brand || p_type), 1, 2) END || substr(md5(p_brand || p_type), 3, 6) || '....' || substr(md5(p_brand || p_type), 13, 2) AS pattern, 0.5::DOUBLE + p_size / 200.0::DOUBLE AS confidence FROM part WHERE p_partkey % 5 = 0),
h AS (SELECT id, sig, confidence, row_number() OVER (PARTITION BY id ORDER BY confidence DESC, sig) AS rn FROM f JOIN p ON length(hex) BETWEEN 14 AND 18 AND hex LIKE replace(pattern, '.', '_') || '%')
SELECT id, sig, round_even(confidence, 6) AS confidence FROM h WHERE rn = 1"""

QUERIES = {
    "hash_match_1to1": (hash_match, _F + "," + _UNIQUE.format(key="code || '|' || return_type", ref="ref", tgt="tgt", one="") + "SELECT r, t, CASE WHEN nt = 1 THEN 0.95 ELSE 0.80 END::DOUBLE AS confidence FROM r JOIN t USING (k)"),
    "fingerprint_match_1to1": (
        fingerprint_match,
        _F + "," + _UNIQUE.format(key="(size, param_count, return_type, convention, thunk)", ref="ref", tgt="tgt", one=" HAVING count(*) = 1") + "SELECT r, t, CASE WHEN k[5] THEN 0.65 WHEN k[1] < 16 THEN 0.70 WHEN k[1] < 64 THEN 0.80 ELSE 0.85 END::DOUBLE AS confidence FROM r JOIN t USING (k)",
    ),
    "quantized_fp_match": (
        quantized_match,
        _F + ", r2 AS (SELECT * FROM ref WHERE size >= 64), t2 AS (SELECT * FROM tgt WHERE size >= 64)," + _UNIQUE.format(key="((size + 7) // 8, param_count, return_type)", ref="r2", tgt="t2", one=" HAVING count(*) = 1")
        + "SELECT r, t, CASE WHEN 2 * len(list_intersect(a.constants, b.constants)) >= len(list_distinct(a.constants || b.constants)) THEN 0.85 ELSE 0.80 END::DOUBLE AS confidence FROM r JOIN t USING (k) JOIN ref a ON a.id = r JOIN tgt b ON b.id = t",
    ),
    "jaccard_best_match": (jaccard_match, _JACCARD),
    "size_tolerance_match": (size_tolerance, _SIZE),
    "neighbor_overlap_match": (neighbor_overlap, _NEIGHBOR),
    "residual_neighbor_match": (residual_neighbor, _RESIDUAL),
    "match_cascade": (match_cascade, _CASCADE),
    "bsim_two_key": (two_key, _TWO),
    "unique_names": (unique_names, "SELECT id, name, CASE WHEN rn = 1 THEN name ELSE name || '-' || rn END AS unique_name FROM (SELECT p_partkey AS id, p_name AS name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part)"),
    "interval_containment": (interval_containment, _CONTAIN),
    "nearest_key": (nearest_key, _NEAREST),
    "range_lookup": (range_lookup, "SELECT s_suppkey AS id, p_partkey * 3 AS key FROM supplier JOIN part ON p_partkey * 3 BETWEEN s_suppkey * 40 AND s_suppkey * 40 + 100"),
    "band_join": (band_join, "SELECT s_suppkey * 97 AS a, p_partkey * 5 AS b FROM supplier JOIN part ON abs(s_suppkey * 97 - p_partkey * 5) <= 60"),
    "prefix_lookup": (prefix_lookup, _PREFIX),
    "canonical_set_lookup": (set_lookup, "SELECT a.p_partkey AS id, b.p_partkey AS probe FROM part a JOIN part b ON b.p_partkey % 4 = 0 AND list_sort([a.p_brand, a.p_type, a.p_size::VARCHAR]) = list_sort([b.p_brand, b.p_type, b.p_size::VARCHAR])"),
    "masked_pattern_match": (masked_pattern, _MASKED),
}
