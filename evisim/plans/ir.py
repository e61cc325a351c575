"""Instruction and layout queries: an order's lineitems are a function's operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evisim.functions.exprs import complexity_class, cyclomatic
from evisim.operators import ir


def _li(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def _ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _li(spark, sf_dir).selectExpr("l_orderkey AS func", "CAST(l_linenumber AS BIGINT) AS seq", "l_suppkey % 6 AS output", "array(l_partkey % 6, l_suppkey % 5) AS inputs", "CASE l_returnflag WHEN 'A' THEN 'arith' WHEN 'N' THEN 'mem' ELSE 'branch' END AS kind")


_OPS = "WITH o AS (SELECT l_orderkey AS func, l_linenumber::BIGINT AS seq, l_suppkey % 6 AS output, [l_partkey % 6, l_suppkey % 5] AS inputs, CASE l_returnflag WHEN 'A' THEN 'arith' WHEN 'N' THEN 'mem' ELSE 'branch' END AS kind FROM lineitem) "


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ir.def_use_chains(_ops(spark, sf_dir))


_CHAINS = _OPS + """, b AS (SELECT func, output AS varnode, 'd' AS k, seq FROM o UNION ALL SELECT func, unnest(inputs), 'u', seq FROM o)
SELECT func, varnode, coalesce(string_agg(DISTINCT seq::VARCHAR, ',' ORDER BY seq::VARCHAR) FILTER (k = 'd'), '') AS defs, coalesce(string_agg(DISTINCT seq::VARCHAR, ',' ORDER BY seq::VARCHAR) FILTER (k = 'u'), '') AS uses FROM b GROUP BY ALL"""


def lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ir.lifetimes(_ops(spark, sf_dir))


_LIFE = _OPS + """, b AS (SELECT func, output AS varnode, seq AS d, NULL AS u FROM o UNION ALL SELECT func, unnest(inputs), NULL, seq FROM o),
l AS (SELECT func, varnode, coalesce(min(d), -1) AS born, coalesce(max(u), max(d)) AS dies, count(u) AS n_uses FROM b GROUP BY ALL) """


def boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ir.usage_boost(ir.lifetimes(_ops(spark, sf_dir)), F.col("varnode") < 3, F.col("varnode") == 5).select("func", "varnode", F.bround("boost", 6).alias("boost"))


def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ir.ratio_class(_ops(spark, sf_dir))


def opcode_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ir.histogram(_ops(spark, sf_dir), "func", "kind")


def type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten commonest types."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_type").limit(10)


def cyclomatic_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _li(spark, sf_dir).groupBy(F.col("l_orderkey").alias("func")).agg(F.countDistinct("l_suppkey").alias("blocks"), (F.count(F.lit(1)) + F.count_if(F.col("l_returnflag") == "R")).alias("edges"), F.count_if(F.col("l_linenumber") == 7).alias("loops"))
    c = cyclomatic(F.col("edges"), F.col("blocks"))
    return per.select("func", c.alias("complexity"), complexity_class(c, F.col("loops")).alias("class"))


_CYCLO = """WITH p AS (SELECT l_orderkey AS func, count(*) + count(*) FILTER (l_returnflag = 'R') - count(DISTINCT l_suppkey) + 2 AS complexity, count(*) FILTER (l_linenumber = 7) AS loops FROM lineitem GROUP BY 1)
SELECT func, complexity, CASE WHEN complexity <= 1 AND loops = 0 THEN 'linear' WHEN loops > 0 THEN CASE WHEN complexity > 10 THEN 'complex' ELSE 'looping' END WHEN complexity > 10 THEN 'complex' ELSE 'branching' END AS class FROM p"""


def _accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _li(spark, sf_dir).selectExpr("l_orderkey AS var", "CAST(l_linenumber * 4 AS BIGINT) AS offset", "CAST(CASE WHEN l_quantity < 15 THEN 1 WHEN l_quantity < 30 THEN 2 WHEN l_quantity < 40 THEN 4 ELSE 8 END AS BIGINT) AS width")


_ACC = "WITH a AS (SELECT l_orderkey AS var, (l_linenumber * 4)::BIGINT AS offset_, CASE WHEN l_quantity < 15 THEN 1 WHEN l_quantity < 30 THEN 2 WHEN l_quantity < 40 THEN 4 ELSE 8 END::BIGINT AS width FROM lineitem) "


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ir.struct_layout(_accesses(spark, sf_dir))


_LAYOUT = _ACC + """, p AS (SELECT var, offset_, max(width) AS width FROM a GROUP BY ALL)
SELECT var, string_agg(offset_ || ':' || width, ',' ORDER BY offset_) AS layout, max(offset_ + width)::BIGINT AS size, (ceil(max(offset_ + width) / max(width)::DOUBLE) * max(width))::BIGINT AS aligned FROM p GROUP BY 1"""


def stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ir.stride(_accesses(spark, sf_dir))


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ir.overlap_and_padding(_accesses(spark, sf_dir))


_OVERLAP = _ACC + """, f AS (SELECT DISTINCT var, offset_ AS s, offset_ + width AS e FROM a),
g AS (SELECT var, s, max(e) OVER (PARTITION BY var ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f),
p AS (SELECT var, sum(CASE WHEN before IS NULL THEN 0 ELSE greatest(s - before, 0) END)::BIGINT AS padding FROM g GROUP BY 1),
o AS (SELECT x.var, count(*) AS n FROM f x JOIN f y ON x.var = y.var AND (x.s, x.e) < (y.s, y.e) AND x.e > y.s GROUP BY 1)
SELECT var, coalesce(n, 0) AS overlaps, padding FROM p LEFT JOIN o USING (var)"""


def cheapest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _li(spark, sf_dir).selectExpr("l_orderkey AS var", "l_linenumber AS family", "l_suppkey AS candidate", "l_partkey % 17 + l_quantity AS cost")
    return ir.cheapest_candidate(rows)


QUERIES = {
    "def_use_chains": (chains, _CHAINS),
    "variable_lifetimes": (lifetimes, _LIFE + "SELECT * FROM l"),
    "usage_boost": (boost, _LIFE + "SELECT func, varnode, round_even(greatest(CASE WHEN n_uses >= 10 THEN 0.3 WHEN n_uses >= 5 THEN 0.2 WHEN n_uses >= 2 THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN varnode < 3 THEN 0.05 ELSE 0 END::DOUBLE - CASE WHEN varnode = 5 THEN 0.1 ELSE 0 END::DOUBLE, 0), 6) AS boost FROM l"),
    "opcode_ratio_class": (ratios, _OPS + ", p AS (SELECT func, count(*) AS n, count(*) FILTER (kind = 'arith') / count(*) AS a, count(*) FILTER (kind = 'mem') / count(*) AS m, count(*) FILTER (kind = 'branch') / count(*) AS b FROM o GROUP BY 1) SELECT func, n, CASE WHEN a >= 0.5 THEN 'computational' WHEN m >= 0.5 THEN 'memory' WHEN b >= 0.4 THEN 'control' ELSE 'mixed' END AS class FROM p"),
    "opcode_histogram_hash": (opcode_histogram, _OPS + ", n AS (SELECT func, kind || ':' || count(*) AS e FROM o GROUP BY func, kind), h AS (SELECT func, string_agg(e, '|' ORDER BY e) AS histogram FROM n GROUP BY 1) SELECT func, histogram, sha256(histogram) AS digest FROM h"),
    "type_histogram": (type_histogram, "SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 10"),
    "cyclomatic_class": (cyclomatic_query, _CYCLO),
    "struct_layout": (layout, _LAYOUT),
    "stride_detect": (stride, _ACC + ", d AS (SELECT DISTINCT var, offset_ FROM a), g AS (SELECT var, offset_ - lag(offset_) OVER (PARTITION BY var ORDER BY offset_) AS gap FROM d) SELECT var, min(gap) AS stride, count(*) AS n FROM g GROUP BY 1 HAVING count(*) >= 3 AND min(gap) = max(gap)"),
    "field_overlap_count": (overlaps, _OVERLAP),
    "separable_layout": (cheapest, "SELECT var, family, candidate, cost FROM (SELECT l_orderkey AS var, l_linenumber AS family, l_suppkey AS candidate, l_partkey % 17 + l_quantity AS cost, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey % 17 + l_quantity, l_suppkey) AS rn FROM lineitem) WHERE rn = 1"),
}
