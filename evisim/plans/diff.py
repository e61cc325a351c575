"""Version diff of two snapshots of a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evisim.operators.diff import diff_summary, version_diff


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of part: the later one lacks some keys, has grown others and adds new ones."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    old = part.filter("p_partkey % 10 <> 3").selectExpr("concat(p_name, ':', p_partkey) AS name", "p_size AS size", "length(p_type) AS instr_count")
    new = part.filter("p_partkey % 10 <> 7").selectExpr(
        "concat(p_name, ':', p_partkey) AS name", "p_size + CASE WHEN p_partkey % 5 = 0 THEN 4 ELSE 0 END AS size", "length(p_type) + CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS instr_count"
    )
    return old, new


def q_version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return version_diff(*_snapshots(spark, sf_dir))


def q_diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff_summary(version_diff(*_snapshots(spark, sf_dir)))


_DIFF_SQL = """
WITH o AS (SELECT p_name || ':' || p_partkey AS name, p_size AS size, length(p_type) AS ic FROM part WHERE p_partkey % 10 <> 3),
n AS (SELECT p_name || ':' || p_partkey AS name, p_size + CASE WHEN p_partkey % 5 = 0 THEN 4 ELSE 0 END AS size,
             length(p_type) + CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS ic FROM part WHERE p_partkey % 10 <> 7),
d AS (SELECT coalesce(o.name, n.name) AS name,
  CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed'
       WHEN o.size = n.size AND (o.ic = n.ic OR o.ic = 0 OR n.ic = 0) THEN 'unchanged' ELSE 'modified' END AS status,
  o.size AS old_size, n.size AS new_size, n.size - o.size AS size_delta,
  CASE WHEN o.ic = 0 OR n.ic = 0 THEN NULL ELSE n.ic - o.ic END AS instr_delta
FROM o FULL JOIN n ON o.name = n.name)
"""

QUERIES = {
    "version_diff": (q_version_diff, _DIFF_SQL + "SELECT * FROM d"),
    "diff_summary": (q_diff_summary, _DIFF_SQL + "SELECT coalesce(status, 'total') AS status, count(*) AS n, sum(coalesce(size_delta, 0))::BIGINT AS size_delta FROM d GROUP BY ROLLUP (status)"),
}
