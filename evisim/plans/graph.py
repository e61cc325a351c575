"""Graph queries: a heap and cross links over part keys, and small cycles over suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evisim.operators import graph as g


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src -> dst with dst > src: acyclic, of logarithmic depth."""
    return _t(spark, sf_dir, "part").selectExpr("p_partkey AS src", "explode(array(2 * p_partkey, 2 * p_partkey + 1, 3 * p_partkey + p_size)) AS dst")


_CALLS = "WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS src, unnest([2 * p_partkey, 2 * p_partkey + 1, 3 * p_partkey + p_size]) AS dst FROM part) "


def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.degrees(_calls(spark, sf_dir))


_DEGREES = _CALLS + """, o AS (SELECT src AS node, count(*) AS n_out FROM e GROUP BY 1), i AS (SELECT dst AS node, count(*) AS n_in FROM e GROUP BY 1),
b AS (SELECT src AS node, count(DISTINCT dst) AS n_neighbors FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) WHERE src <> dst GROUP BY 1)
SELECT node, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in, coalesce(n_neighbors, 0) AS n_neighbors FROM o FULL JOIN i USING (node) LEFT JOIN b USING (node)"""


def hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = _t(spark, sf_dir, "part").filter("p_partkey % 2 = 0").selectExpr("p_partkey AS node", "p_size / 51.0D AS confidence")
    return g.hint_propagation(_calls(spark, sf_dir), seeds).withColumn("confidence", F.bround("confidence", 6))


_HINTS = _CALLS + """, s AS (SELECT p_partkey AS node, p_size / 51.0::DOUBLE AS confidence FROM part WHERE p_partkey % 2 = 0),
b AS (SELECT src AS h, max(confidence * 0.3::DOUBLE) AS hint FROM e JOIN s ON dst = node WHERE confidence >= 0.70 GROUP BY 1 HAVING max(confidence * 0.3::DOUBLE) >= 0.15)
SELECT coalesce(node, h) AS node, round_even(CASE WHEN node IS NULL THEN hint WHEN confidence < 0.50 AND hint IS NOT NULL THEN least(confidence + 0.5::DOUBLE * hint, 0.60::DOUBLE) ELSE confidence END, 6) AS confidence,
CASE WHEN node IS NULL THEN 'caller' WHEN confidence < 0.50 AND hint IS NOT NULL THEN 'boosted' ELSE 'seed' END AS origin FROM s FULL JOIN b ON node = h"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _t(spark, sf_dir, "part").filter("p_partkey % 8 = 0").selectExpr("p_partkey AS node", "p_type AS domain")
    return g.profile_propagation(_calls(spark, sf_dir), known).withColumn("confidence", F.bround("confidence", 6))


def _profile_sql() -> str:
    out = _CALLS + ", k0 AS (SELECT p_partkey AS node, p_type AS domain, 1.0::DOUBLE AS confidence, -1 AS round FROM part WHERE p_partkey % 8 = 0), go0 AS (SELECT true AS ok)"
    for r in range(5):  # base * decay^5 is below the stop
        out += f""", v{r} AS (SELECT src, domain, count(*) AS n FROM e JOIN k{r} ON dst = node GROUP BY ALL),
w{r} AS (SELECT src, domain FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, domain) AS rn FROM v{r}) WHERE rn = 1 AND src NOT IN (SELECT node FROM k{r}) AND (SELECT ok FROM go{r})),
k{r + 1} AS (SELECT * FROM k{r} UNION ALL SELECT src, domain, {0.9 * 0.8**r}::DOUBLE, {r} FROM w{r}), go{r + 1} AS (SELECT (SELECT ok FROM go{r}) AND (SELECT count(*) FROM w{r}) > 0 AND (SELECT count(*) FROM w{r}) >= 0.01 * (SELECT count(*) FROM k{r + 1}) AS ok)"""
    return out + " SELECT node, domain, round_even(confidence, 6) AS confidence, round FROM k5"


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _t(spark, sf_dir, "part").selectExpr("p_partkey AS src", "p_partkey + p_size * 40 AS dst")
    return g.min_label_components(edges)


_COMPONENTS = """WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey + p_size * 40 AS b FROM part), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
n AS (SELECT DISTINCT a AS node FROM u), r AS (SELECT node, node AS reach FROM n UNION SELECT r.node, u.b FROM r JOIN u ON r.reach = u.a) SELECT node, min(reach) AS component FROM r GROUP BY 1"""


def sccs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _t(spark, sf_dir, "supplier")
    return g.strong_components(s.selectExpr("s_suppkey AS src", "explode(array(CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey - 3 ELSE s_suppkey + 1 END, CASE WHEN s_suppkey % 8 = 1 THEN s_suppkey + 4 ELSE s_suppkey END)) AS dst"))


_SCC = """WITH RECURSIVE e AS (SELECT s_suppkey AS src, unnest([CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey - 3 ELSE s_suppkey + 1 END, CASE WHEN s_suppkey % 8 = 1 THEN s_suppkey + 4 ELSE s_suppkey END]) AS dst FROM supplier),
n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), r AS (SELECT node, node AS reach FROM n UNION SELECT r.node, e.dst FROM r JOIN e ON r.reach = e.src)
SELECT a.node, min(a.reach) AS scc FROM r a JOIN r b ON a.node = b.reach AND a.reach = b.node GROUP BY 1"""


def longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.longest_path(_calls(spark, sf_dir).filter("src < dst"))  # key 0 calls itself


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _t(spark, sf_dir, "supplier").selectExpr("s_suppkey AS src", "explode(array(s_suppkey + 1, s_suppkey - 2, 2 * s_suppkey)) AS dst")
    roots = _t(spark, sf_dir, "supplier").selectExpr("s_suppkey AS node")
    return g.trace_paths(edges, roots, 4).select("root", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "depth")


_TRACES = """WITH RECURSIVE e AS (SELECT DISTINCT s_suppkey AS src, unnest([s_suppkey + 1, s_suppkey - 2, 2 * s_suppkey]) AS dst FROM supplier),
t AS (SELECT s_suppkey AS root, [s_suppkey] AS path, 0 AS depth FROM supplier UNION ALL SELECT root, list_append(path, dst), depth + 1 FROM t JOIN e ON path[-1] = src WHERE depth < 4 AND NOT list_contains(path, dst))
SELECT root, array_to_string(path, '>') AS path, depth FROM t"""


def reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = _t(spark, sf_dir, "part").selectExpr("p_partkey AS node")
    return g.closure_depth(_calls(spark, sf_dir), roots, 4)


_REACH = _CALLS + """, r AS (SELECT p_partkey AS root, p_partkey AS node, 0 AS depth FROM part UNION SELECT root, dst, depth + 1 FROM r JOIN e ON node = src WHERE depth < 4)
SELECT root, node, min(depth) AS depth FROM r GROUP BY ALL"""


def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.label_propagation(_calls(spark, sf_dir), sweeps=3)


def _communities_sql() -> str:
    out = _CALLS + ", b AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst), l0 AS (SELECT DISTINCT src AS node, src AS label FROM b)"
    for i in range(3):
        out += f", l{i + 1} AS (SELECT src AS node, label FROM (SELECT src, label, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, label) AS rn FROM b JOIN l{i} ON dst = node GROUP BY src, label) WHERE rn = 1)"
    return out + " SELECT * FROM l3"


def writer_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    acc = _t(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS field", "l_partkey AS func", "CASE WHEN l_linenumber % 2 = 0 THEN 'w' ELSE 'r' END AS kind")
    return g.writer_reader_edges(acc, _calls(spark, sf_dir)).withColumn("confidence", F.bround("confidence", 6))


_WR = _CALLS + """, a AS (SELECT DISTINCT l_orderkey AS field, l_partkey AS func, CASE WHEN l_linenumber % 2 = 0 THEN 'w' ELSE 'r' END AS kind FROM lineitem),
f AS (SELECT field FROM a GROUP BY 1 HAVING count(*) <= 500), p AS (SELECT x.func AS writer, y.func AS reader, x.field FROM a x JOIN a y ON x.field = y.field AND x.kind = 'w' AND y.kind = 'r' AND x.func <> y.func WHERE x.field IN (SELECT field FROM f)),
s AS (SELECT DISTINCT x.dst AS writer, y.dst AS reader FROM e x JOIN e y ON x.src = y.src)
SELECT writer, reader, field, round_even(least(0.45::DOUBLE + CASE WHEN (writer, reader) IN (SELECT (writer, reader) FROM s) THEN 0.15 ELSE 0 END::DOUBLE + CASE WHEN (writer, reader) IN (SELECT (src, dst) FROM e) THEN 0.20 ELSE 0 END::DOUBLE + CASE WHEN (reader, writer) IN (SELECT (src, dst) FROM e) THEN 0.10 ELSE 0 END::DOUBLE, 1), 6) AS confidence FROM p"""


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _t(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS entity", "l_suppkey % 30 AS indicator")
    stages = _t(spark, sf_dir, "supplier").selectExpr("concat('t', s_suppkey % 4) AS template", "s_suppkey % 12 AS stage", "s_suppkey % 30 AS indicator")
    return g.template_match(found, stages).withColumn("coverage", F.bround("coverage", 6))


_TEMPLATES = """WITH f AS (SELECT DISTINCT l_orderkey AS entity, l_suppkey % 30 AS indicator FROM lineitem), s AS (SELECT DISTINCT 't' || s_suppkey % 4 AS template, s_suppkey % 12 AS stage, s_suppkey % 30 AS indicator FROM supplier),
n AS (SELECT template, stage, count(*) AS n FROM s GROUP BY ALL), t AS (SELECT template, count(DISTINCT stage) AS total FROM s GROUP BY 1),
h AS (SELECT entity, template, stage, count(*) AS h FROM f JOIN s USING (indicator) GROUP BY ALL),
p AS (SELECT entity, template, sum(least(1.0::DOUBLE, h / (0.3::DOUBLE * n))) AS s, count(*) AS n_stages FROM h JOIN n USING (template, stage) GROUP BY ALL)
SELECT entity, template, round_even(s / total, 6) AS coverage, n_stages FROM p JOIN t USING (template) WHERE n_stages >= greatest(2, ceil(0.4::DOUBLE * total))"""


def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct functions of each data object in order of first use."""
    li = _t(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS object", "l_suppkey AS func", "l_linenumber * 1000000 + l_suppkey AS at")
    first = li.groupBy("object", "func").agg(F.min("at").alias("at"))
    out = first.groupBy("object").agg(F.array_sort(F.collect_list(F.struct("at", "func"))).alias("s"))
    return out.select("object", F.array_join(F.transform("s", lambda x: x["func"].cast("string")), ">").alias("functions"), F.size("s").alias("n"))


QUERIES = {
    "degree_adjacency": (degrees, _DEGREES),
    "hint_propagation": (hints, _HINTS),
    "callee_profile_propagation": (profiles, _profile_sql()),
    "connected_components": (components, _COMPONENTS),
    "mutual_reachability_scc": (sccs, _SCC),
    "longest_pipeline": (longest, _CALLS + ", a AS (SELECT * FROM e WHERE src < dst), b AS (SELECT src AS node, 0 AS depth FROM a UNION SELECT dst, 0 FROM a), d AS (SELECT * FROM b UNION SELECT a.dst, depth + 1 FROM d JOIN a ON node = src) SELECT node, max(depth) AS depth FROM d GROUP BY 1"),
    "trace_paths": (traces, _TRACES),
    "reach_depth": (reach, _REACH),
    "label_communities": (communities, _communities_sql()),
    "writer_reader_edges": (writer_reader, _WR),
    "template_composition": (templates, _TEMPLATES),
    "object_lifecycle": (lifecycle, "SELECT object, string_agg(func, '>' ORDER BY pos) AS functions, count(*)::INT AS n FROM (SELECT l_orderkey AS object, l_suppkey AS func, min(l_linenumber * 1000000 + l_suppkey) AS pos FROM lineitem GROUP BY ALL) GROUP BY 1"),
}
