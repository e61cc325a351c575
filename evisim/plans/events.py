"""Event, reader and sink queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from evisim.operators.graph import checkpointed
from evisim.sources import readers, writers
from evisim.streaming import events as ev


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CAT = "CASE WHEN event_type IN ('purchase', 'refund') THEN 'money' WHEN event_type IN ('click', 'view') THEN 'browse' ELSE 'other' END"


def category_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.stats(_t(spark, sf_dir, "events")).drop("first", "last")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.tumbling(_t(spark, sf_dir, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


_WINDOWS = f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, {_CAT} AS category, count(*) AS n, round_even(sum(value), 4) AS total FROM events GROUP BY ALL"


def windows_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows from a stream over the same file."""
    checkpointed(spark.range(1))  # a local session without a shared folder gets one
    folder = (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")
    out = ev.run_to_table(ev.tumbling(ev.read_stream(spark, sf_dir, "events.parquet*")), f"{folder}/stream-{uuid.uuid4().hex}")
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.sliding(_t(spark, sf_dir, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


_SLIDING = "WITH e AS (SELECT event_type, unnest([time_bucket(INTERVAL 3 HOURS, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 3 HOURS, ts, TIMESTAMP '1970-01-01') - INTERVAL 3 HOURS]) AS s FROM events) SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM e GROUP BY ALL"


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.sessions(_t(spark, sf_dir, "events")).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


_SESSIONS = """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS cut FROM events), r AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM r GROUP BY user_id, run"""


def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.sequences(_t(spark, sf_dir, "events"))


def props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))


def printable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", F.size(readers.printable_runs(F.col("html"), 8)).cast("long").alias("runs"))


def naming_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    maps = [(k, part.filter(f"p_partkey % {d} = 0").selectExpr("p_partkey AS key", f"concat({c}, '-{k}') AS value")) for k, d, c in ((1, 3, "p_name"), (2, 2, "p_brand"), (3, 1, "p_type"))]
    return writers.merge_maps(maps)


def dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.dot_lines(_t(spark, sf_dir, "part").selectExpr("p_partkey AS src", "p_partkey * 2 AS dst"))


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "part").selectExpr("concat(upper(substr(md5(p_brand), 1, 8)), '..', lpad(hex(p_size), 2, '0'), ' 04 ABCD 0020 :0000 ', replace(p_name, ' ', '_'), '_', p_partkey) AS value")
    return readers.signature_lines(lines).select("name", F.lower(F.hex("pattern")).alias("pattern"), F.lower(F.hex("mask")).alias("mask"), "size")


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", readers.address(F.concat(F.lit("0x"), F.hex(F.col("p_partkey") * 4096))).alias("addr"))


def top_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature: a bounded report of the strongest matches."""
    return writers.budget(_t(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_retailprice AS confidence"), 50)


QUERIES = {
    "event_category_stats": (category_stats, f"SELECT {_CAT} AS category, count(*) AS n, count(DISTINCT user_id) AS users, round_even(avg(value), 4) AS mean FROM events GROUP BY 1"),
    "event_windows": (windows, _WINDOWS),
    "event_windows_stream": (windows_stream, _WINDOWS),
    "event_sliding_windows": (sliding, _SLIDING),
    "event_sessions": (sessions, _SESSIONS),
    "event_sequence": (sequence, "SELECT user_id, event_id, row_number() OVER w::INT AS pos, event_type, lead(event_type) OVER w AS next_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)".replace("row_number() OVER w::INT", "(row_number() OVER w)::INT")),
    "event_props": (props, "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1"),
    "printable_strings": (printable, r"SELECT page_id, len(regexp_extract_all(html, '[\x20-\x7e]{8,}'))::BIGINT AS runs FROM pages"),
    "naming_map_merge": (naming_map, "SELECT p_partkey AS key, CASE WHEN p_partkey % 3 = 0 THEN p_name || '-1' WHEN p_partkey % 2 = 0 THEN p_brand || '-2' ELSE p_type || '-3' END AS value, CASE WHEN p_partkey % 3 = 0 THEN 1 WHEN p_partkey % 2 = 0 THEN 2 ELSE 3 END::INT AS priority FROM part"),
    "dot_edges": (dot, "SELECT '  \"' || p_partkey || '\" -> \"' || p_partkey * 2 || '\";' AS value FROM part"),
    "signature_lines": (signatures, "SELECT replace(p_name, ' ', '_') || '_' || p_partkey AS name, substr(md5(p_brand), 1, 8) || '00' || lpad(lower(to_hex(p_size)), 2, '0') AS pattern, 'ffffffff00ff' AS mask, 6::INT AS size FROM part"),
    "address_parse": (addresses, "SELECT p_partkey, p_partkey * 4096 AS addr FROM part"),
    "match_budget": (top_confidence, "SELECT p_partkey AS id, p_retailprice AS confidence FROM part ORDER BY confidence DESC, id LIMIT 50"),
}
