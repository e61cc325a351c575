"""Event aggregates that run alike on batches and streams, and the streaming runs themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

SCHEMA = "event_id LONG, ts TIMESTAMP, user_id LONG, event_type STRING, value DOUBLE, props STRING"


def category(kind: Column) -> Column:
    return F.when(kind.isin("purchase", "refund"), "money").when(kind.isin("click", "view"), "browse").otherwise("other")


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, category, n, total of event-time windows."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width), category(F.col("event_type")).alias("category"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "category", "n", F.bround("total", 4).alias("total"))


def sliding(events: DataFrame, width: str = "6 hours", step: str = "3 hours", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width, step), "event_type")
    return rows.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, start, stop, n of runs of a user's events without a longer gap."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return rows.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def first_of(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events without repeated ids; a stream forgets ids older than the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def sequences(events: DataFrame) -> DataFrame:
    """user_id, event_id, pos, event_type, next_type: a user's events in order of time."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select("user_id", "event_id", F.row_number().over(w).alias("pos"), "event_type", F.lead("event_type").over(w).alias("next_type"))


def stats(events: DataFrame) -> DataFrame:
    return events.groupBy(category(F.col("event_type")).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.bround(F.avg("value"), 4).alias("mean"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def read_stream(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("pathGlobFilter", glob).parquet(folder)


def run_to_table(stream: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """Runs a streaming aggregate over all that is there, writing each batch's result to a folder of its own, and reads the last."""
    last: list[str] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        last.append(f"{path}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    spark = stream.sparkSession
    return spark.read.parquet(last[-1]) if last else spark.createDataFrame([], stream.schema)
