"""Text queries over documents, pages and part names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evisim.functions import exprs as ex
from evisim.operators import text as tx
from evisim.tables import written


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _t(spark, sf_dir, "part").selectExpr("p_partkey", "concat(CASE p_partkey % 3 WHEN 0 THEN 'm_' WHEN 1 THEN '__' ELSE 'g_' END, replace(initcap(p_name), ' ', ''), CASE p_partkey % 2 WHEN 0 THEN '_' ELSE '' END) AS raw")
    return made.select("p_partkey", ex.normalize_name(F.col("raw")).alias("name"), ex.meaningful_name(F.col("raw")).alias("meaningful"))


_NAMES = r"""WITH r AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'm_' WHEN 1 THEN '__' ELSE 'g_' END || (SELECT string_agg(upper(x[1]) || lower(x[2:]), '') FROM (SELECT unnest(string_split(p_name, ' ')) AS x)) || CASE p_partkey % 2 WHEN 0 THEN '_' ELSE '' END AS raw FROM part)
SELECT p_partkey, regexp_replace(lower(regexp_replace(regexp_replace(raw, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '^[msgp]_', '')), '^_+|_+$', '', 'g') AS name, length(raw) >= 3 AND regexp_matches(raw, '^[A-Za-z][A-Za-z0-9]*(_[A-Za-z0-9]+)*$') AS meaningful FROM r"""


#: Pairs of names up to which the table of them is sent.
NAME_PAIRS = 100_000


def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a brand and size. Two names are compared once, wherever they meet; pairs of keys look them up."""
    p = _t(spark, sf_dir, "part").selectExpr("p_partkey", "replace(p_name, ' ', '_') AS a", "p_brand", "p_size", "p_partkey % 2 = 0 AS even")
    x = p.drop("even")
    y = p.select(F.col("p_partkey").alias("t"), F.col("a").alias("c"), "even", "p_brand", "p_size")
    at = ["p_brand", "p_size"]
    names = x.select("a", *at).distinct().join(y.select("c", "even", *at).distinct(), at).select("a", "c", "even").distinct()
    a, b = F.col("a"), F.concat("c", F.when(F.col("even"), "").otherwise("_x"))
    compared = written(names.select(a.alias("a1"), F.col("c").alias("c1"), F.col("even").alias("e1"), F.bround(ex.partial_overlap(a, b), 6).alias("overlap"), F.bround(ex.jaccard(ex.words_of(a), ex.words_of(b)), 6).alias("jaccard")))
    compared = F.broadcast(compared) if compared.limit(NAME_PAIRS + 1).count() <= NAME_PAIRS else compared
    pairs = x.join(y, at).filter("p_partkey < t")
    return pairs.join(compared, a.eqNullSafe(F.col("a1")) & F.col("c").eqNullSafe(F.col("c1")) & (F.col("even") == F.col("e1"))).select(F.col("p_partkey").alias("r"), "t", "overlap", "jaccard")


_OVERLAP = """WITH p AS (SELECT p_partkey AS k, replace(p_name, ' ', '_') AS a, p_brand, p_size FROM part), q AS (SELECT x.k AS r, y.k AS t, x.a, y.a || CASE WHEN y.k % 2 = 0 THEN '' ELSE '_x' END AS b FROM p x JOIN p y ON x.p_brand = y.p_brand AND x.p_size = y.p_size AND x.k < y.k),
j AS (SELECT *, len(list_intersect(string_split(a, '_'), string_split(b, '_'))) / len(list_distinct(string_split(a, '_') || string_split(b, '_'))) AS j FROM q)
SELECT r, t, round_even(CASE WHEN contains(a, b) OR contains(b, a) THEN least(length(a), length(b)) / greatest(length(a), length(b)) ELSE j END, 6) AS overlap, round_even(j, 6) AS jaccard FROM j"""


def code_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.code_groups(_t(spark, sf_dir, "documents").selectExpr("doc_id AS func_id", "text AS code"))


_NORM = "text"
for _p, _n in ((r"/\*[^*]*\*+([^/*][^*]*\*+)*/", " "), (r"//[^\n]*", " "), (r"\b(FUN|sub|thunk)_[0-9a-fA-F]+\b", "FUNC"), (r"\b(DAT|PTR|LAB)_[0-9a-fA-F]+\b", "DATA"), (r"\blocal_[0-9a-fA-F]+\b", "LOCAL"), (r"\bparam_[0-9]+\b", "PARAM"), (r"\b[a-z]{1,3}Var[0-9]+\b", "VAR"), (r"\b0x[0-9a-fA-F]+\b", "HEX"), (r"[\s\x0b]+", " ")):
    _NORM = f"regexp_replace({_NORM}, '{_p}', '{_n}', 'g')"


def entropies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.entropies(_t(spark, sf_dir, "documents")).select("doc_id", F.bround("entropy", 6).alias("entropy"))


_ENTROPY = """WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents), n AS (SELECT doc_id, count(*) AS n FROM c WHERE ch <> '' GROUP BY doc_id, ch), t AS (SELECT doc_id, sum(n) AS total FROM n GROUP BY 1)
SELECT doc_id, round_even(coalesce(e, 0), 6) AS entropy FROM documents LEFT JOIN (SELECT doc_id, -sum(n / total * log2(n / total)) AS e FROM n JOIN t USING (doc_id) GROUP BY 1) USING (doc_id)"""


def nestings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", tx.nesting(F.col("html")).alias("depth"))


_NEST = r"""WITH m AS (SELECT page_id, regexp_extract_all(html, '[{}()]') AS m FROM pages), u AS (SELECT page_id, unnest(m) AS c, unnest(range(len(m))) AS i FROM m),
d AS (SELECT page_id, sum(CASE WHEN c IN ('{', '(') THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY i) AS d FROM u), x AS (SELECT page_id, max(d) AS d FROM d GROUP BY 1)
SELECT page_id, greatest(coalesce(d, 0), 0)::INT AS depth FROM pages LEFT JOIN x USING (page_id)"""


def readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        (100 * F.avg("l_discount") * 10).alias("names"), (F.avg("l_tax") * 1000).alias("params"), F.avg("l_quantity").alias("locals"), (100 - F.avg("l_linenumber") * 10).alias("types"), F.least(F.lit(100.0), F.count(F.lit(1)) / 2 * 10).alias("comments"),
        tx.structure_score(F.avg("l_linenumber"), F.count_if(F.col("l_returnflag") == "R"), F.avg("l_quantity") * 3).alias("structure"),
    )
    return tx.readability(d).withColumn("score", F.bround("score", 5))


_READABLE = """SELECT l_orderkey AS id, round_even(100 * avg(l_discount) * 10 * 0.25::DOUBLE + avg(l_tax) * 1000 * 0.15::DOUBLE + avg(l_quantity) * 0.15::DOUBLE + (100 - avg(l_linenumber) * 10) * 0.20::DOUBLE + least(100.0::DOUBLE, count(*) / 2 * 10) * 0.10::DOUBLE
 + least(greatest(100 - (5 * avg(l_linenumber) + 10 * count(*) FILTER (l_returnflag = 'R') + least(greatest((avg(l_quantity) * 3 - 50) / 100 * 40, 0), 40)), 0), 100) * 0.15::DOUBLE, 5) AS score FROM lineitem GROUP BY 1"""


def ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.ngram_counts(_t(spark, sf_dir, "documents"), 3, "lang")


_NGRAMS = r"""WITH w AS (SELECT lang AS name, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents), g AS (SELECT name, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2])) AS g FROM w WHERE len(w) >= 3),
n AS (SELECT g, name, count(*) AS n FROM g GROUP BY ALL), t AS (SELECT *, (sum(n) OVER (PARTITION BY g))::BIGINT AS total, row_number() OVER (PARTITION BY g ORDER BY n DESC, name) AS rn FROM n)
SELECT substr(sha256(g), 1, 24) AS digest, name, n, total, rn::INT AS rn FROM t WHERE total >= 2 AND rn <= 5"""

RULES = (("license", "icense", "[Ll]icen[sc]ed? under"), ("bang", "!!", "[A-Z]{3,}!!"), ("table", " | ", r"\w+ \| \w+"), ("mail", "@", r"[a-z0-9.]+@[a-z0-9.]+"), ("amp", "&&&", "&{3}"))


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.rule_scan(_t(spark, sf_dir, "documents"), RULES)


_RULES = "SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS rule, len(regexp_extract_all(text, '{p}'))::BIGINT AS n FROM documents WHERE contains(text, '{lit}')" for n, lit, p in RULES) + ") WHERE n > 0"
GROUPS = (("brand1", "^Brand#1"), ("brand2", "^Brand#2"), ("odd", "[13579]$"), ("three", "3"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.string_clusters(_t(spark, sf_dir, "part").selectExpr("p_brand AS value"), GROUPS, most=6)


_CLUSTERS = "WITH h AS (" + " UNION ALL ".join(f"SELECT '{c}' AS category, p_brand AS value FROM part WHERE regexp_matches(p_brand, '{p}')" for c, p in GROUPS) + """), c AS (SELECT category, value, count(*) AS n FROM h GROUP BY ALL), v AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY value) AS rn FROM c)
SELECT category, sum(n)::BIGINT AS n, string_agg(value, ';' ORDER BY value) FILTER (rn <= 6) AS evidence FROM v GROUP BY 1"""


def version_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.versions(_t(spark, sf_dir, "documents").selectExpr("text AS value"), (("apache", r"Apache License, Version ([0-9.]+[0-9])"), ("gpl", r"General Public License, version ([0-9]+)"), ("cc", r"CC BY-NC ([0-9]+\.[0-9]+)")))


_VERSIONS = " UNION ALL ".join(
    f"SELECT '{lib}' AS library, v AS version, count(*) AS n FROM (SELECT regexp_extract(text, '{p}', 1) AS v FROM documents) WHERE v <> '' GROUP BY ALL" for lib, p in (("apache", r"Apache License, Version ([0-9.]+[0-9])"), ("gpl", r"General Public License, version ([0-9]+)"), ("cc", r"CC BY-NC ([0-9]+\.[0-9]+)"))
)


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _t(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS group", "l_orderkey AS pos").distinct()
    return tx.gap_groups(items, 20, 3)


_GAPS = """WITH i AS (SELECT DISTINCT l_suppkey AS g, l_orderkey AS pos FROM lineitem), c AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY g ORDER BY pos) <= 20 THEN 0 ELSE 1 END AS cut FROM i),
r AS (SELECT *, sum(cut) OVER (PARTITION BY g ORDER BY pos) AS run FROM c) SELECT g AS "group", min(pos) AS first, max(pos) AS last, count(*) AS n FROM r GROUP BY g, run HAVING count(*) >= 3"""


def constant_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(ex.constants(F.col("text")), lambda x: x.cast("string")), ",").alias("constants")).filter("constants <> ''")


_CONSTANTS = r"""WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '\b0x([0-9a-fA-F]{1,8})\b', 1), lambda x: ('0x' || x)::BIGINT) || list_transform(regexp_extract_all(text, '\b([0-9]{2,10})\b', 1), lambda x: x::BIGINT) AS c FROM documents),
s AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(c, lambda x: x BETWEEN 16 AND 4294967295))), ',') AS constants FROM d) SELECT * FROM s WHERE constants <> ''"""


def fusion_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of a part against its brand's average, and their log-odds score."""
    part = _t(spark, sf_dir, "part")
    ref = part.groupBy("p_brand").agg(F.avg("p_size").alias("rs"), (F.max("p_retailprice") * 1.0371).alias("rp"))
    j = part.join(F.broadcast(ref) if ref.limit(10_001).count() <= 10_000 else ref, "p_brand")
    f = j.select("p_partkey", ex.size_ratio(F.col("p_size") + 0.317, F.col("rs")).alias("size_ratio"), ex.log_scale(F.col("p_retailprice"), 3000.0).alias("log_price"), ex.size_similarity(F.col("p_retailprice"), F.col("rp")).alias("price_sim"))
    score = ex.sigmoid(-3.5 + 1.2 * F.col("size_ratio") + 2.1 * F.col("log_price") + 1.7 * F.col("price_sim"))
    return f.select("p_partkey", *[F.bround(c, 6).alias(c) for c in ("size_ratio", "log_price", "price_sim")], F.bround(score, 6).alias("score"))


_FUSION = """WITH r AS (SELECT p_brand, avg(p_size) AS rs, max(p_retailprice) * 1.0371::DOUBLE AS rp FROM part GROUP BY 1),
f AS (SELECT p_partkey, least(p_size + 0.317::DOUBLE, rs) / greatest(p_size + 0.317::DOUBLE, rs) AS size_ratio, least(greatest(ln(1 + p_retailprice) / ln(1 + 3000.0::DOUBLE), 0), 1) AS log_price, 1 - abs(p_retailprice - rp) / greatest(p_retailprice, rp) AS price_sim FROM part JOIN r USING (p_brand))
SELECT p_partkey, round_even(size_ratio, 6) AS size_ratio, round_even(log_price, 6) AS log_price, round_even(price_sim, 6) AS price_sim, round_even(1 / (1 + exp(-(-3.5::DOUBLE + 1.2::DOUBLE * size_ratio + 2.1::DOUBLE * log_price + 1.7::DOUBLE * price_sim))), 6) AS score FROM f"""

QUERIES = {
    "name_normalize": (names, _NAMES),
    "partial_overlap": (overlap, _OVERLAP),
    "normalized_code_dedup": (code_dedup, f"SELECT sha256(trim({_NORM})) AS digest, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1"),
    "entropy_by_doc": (entropies, _ENTROPY),
    "nesting_depth": (nestings, _NEST),
    "readability_score": (readable, _READABLE),
    "ngram_train_topk": (ngrams, _NGRAMS),
    "token_rule_scan": (rules, _RULES),
    "string_clusters": (clusters, _CLUSTERS),
    "version_detect": (version_scan, _VERSIONS),
    "gap_groups": (gaps, _GAPS),
    "constant_extract": (constant_scan, _CONSTANTS),
    "fusion_features": (fusion_features, _FUSION),
}
