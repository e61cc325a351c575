"""Vector and MinHash queries over embeddings and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evisim.operators import vectors as v


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS v", "label")


def _banked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors as queries, the labels 0 to 2 as template bank."""
    e = _embeddings(spark, sf_dir)
    return e, e.filter("label < 3")


_P = """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), p AS (SELECT a.id AS r, b.id AS t, round_even(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a JOIN e b ON b.label < 3 AND a.id <> b.id) """


def cosine_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.cosine_best(*_banked(spark, sf_dir), least=0.30)


_BEST = _P + """, f AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, t) AS n FROM p WHERE score >= 0.30), g AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, r) AS n2 FROM f WHERE n = 1)
SELECT r, t, score, round_even(least(score * 0.88::DOUBLE, 0.95::DOUBLE), 6) AS confidence FROM g WHERE n2 = 1"""


def cosine_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.margin_topk(v.cosine_pairs(*_banked(spark, sf_dir), least=0.20, k=3), margin=0.02)


_MARGIN = _P + """, w AS (SELECT *, row_number() OVER x AS rn, lead(score) OVER x AS nx FROM p WHERE score >= 0.20 WINDOW x AS (PARTITION BY r ORDER BY score DESC, t)),
g AS (SELECT *, max(CASE WHEN rn = 1 THEN round_even(score - nx, 6) END) OVER (PARTITION BY r) AS gap FROM w) SELECT r, t, score, rn::INT AS rn FROM g WHERE rn <= 3 AND (gap IS NULL OR gap >= 0.02)"""


def hash_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, templates = _banked(spark, sf_dir)
    mark = lambda d: d.withColumn("hash", F.expr("concat(label, '/', id % 9)"))
    return v.prefilter_match(mark(queries), mark(templates), equal=0.10, otherwise=0.33)


_PREFILTER = _P + """, s AS (SELECT p.*, row_number() OVER (PARTITION BY r ORDER BY score DESC, t) AS n FROM p JOIN e a ON a.id = r JOIN e b ON b.id = t WHERE a.label = b.label AND r % 9 = t % 9 AND score >= 0.10),
o AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, t) AS n FROM p WHERE score >= 0.33 AND r NOT IN (SELECT r FROM s))
SELECT r, t, score, 0.85::DOUBLE AS confidence FROM s WHERE n = 1 UNION ALL SELECT r, t, score, 0.70::DOUBLE FROM o WHERE n = 1"""


def lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    sets = li.selectExpr("l_partkey AS id", "CAST(l_suppkey % 40 AS STRING) AS token").distinct().groupBy("id").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    return v.lsh_candidates(sets, sets.filter("id % 20 = 0")).withColumn("agreement", F.bround("agreement", 6))


_LSH = """WITH s AS (SELECT l_partkey AS id, list_sort(list(DISTINCT (l_suppkey % 40)::VARCHAR)) AS tokens FROM lineitem GROUP BY 1),
g AS (SELECT id, list_transform(range(16), lambda i: list_min(list_transform(tokens, lambda t: ('0x' || substr(md5(i || ':' || t), 1, 7))::BIGINT))) AS sig FROM s),
b AS (SELECT id, sig, unnest(list_transform(range(4), lambda i: i || ',' || array_to_string(sig[i * 4 + 1 : i * 4 + 4], ','))) AS band FROM g),
h AS (SELECT DISTINCT a.id AS r, b.id AS t FROM b a JOIN b ON a.band = b.band AND a.id <> b.id AND a.id % 20 = 0),
c AS (SELECT r, t, round_even(len(list_filter(range(1, 17), lambda i: x.sig[i] = y.sig[i])) / 16.0::DOUBLE, 6) AS agreement FROM h JOIN g x ON x.id = r JOIN g y ON y.id = t)
SELECT r, t, agreement FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY agreement DESC, t) AS rn FROM c) WHERE rn <= 5"""

QUERIES = {"cosine_best_match": (cosine_best, _BEST), "cosine_margin_topk": (cosine_margin, _MARGIN), "hash_prefilter_match": (hash_prefilter, _PREFILTER), "lsh_candidates": (lsh, _LSH)}
