"""Queries over the event stream, as a batch and as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.session import cut, table
from codelake.streaming import changes


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(df: DataFrame, *columns: str) -> DataFrame:
    """Times without a zone, as the tables have them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def q_debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(changes.sessions(_events(spark, sf_dir), ["event_type"], gap="2 minutes"), "start", "end")


def q_user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(changes.sessions(_events(spark, sf_dir), ["user_id"], gap="1 hour"), "start", "end")


def q_last_op_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user and hour-long run: the last event of each type of value."""
    return _plain(changes.last_operations(_events(spark, sf_dir), ["user_id"], "event_type", "event_id", "ts", "event_id", "1 hour"), "start")


def q_tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _events(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return _plain(counted.select(F.col("w.start").alias("start"), "event_type", "n", "total"), "start")


def q_sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _events(spark, sf_dir).groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return _plain(counted.select(F.col("w.start").alias("start"), "n"), "start")


def q_stream_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The debounced runs per event type, made by a stream over the events file; runs the watermark has not closed are still open."""
    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    cut(spark.range(1))  # makes sure of the shared folder
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/debounce-{uuid.uuid4().hex}"
    runs = changes.debounced(source.withColumn("ts", F.col("ts").cast("timestamp")), "event_type", gap="2 minutes")
    query = runs.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("event_type string, start timestamp, end timestamp, n_events bigint").parquet(f"{folder}/out")


QUERIES = {
    "q_debounce_sessions": q_debounce_sessions, "q_user_sessions": q_user_sessions, "q_last_op_per_key": q_last_op_per_key,
    "q_tumbling_window": q_tumbling_window, "q_sliding_window": q_sliding_window, "q_stream_debounce": q_stream_debounce,
}


def _sessions(key: str, gap: str) -> str:
    return f"""o as (select *, case when ts <= lag(ts) over (partition by {key} order by ts, event_id) + interval '{gap}' then 0 else 1 end as b from events where ts is not null),
      g as (select *, sum(b) over (partition by {key} order by ts, event_id) as s from o),
      runs as (select {key}, s, min(ts) as start, max(ts) + interval '{gap}' as "end", count(*) as n_events from g group by 1, 2)"""


ORACLE = {
    "q_debounce_sessions": f"""with {_sessions("event_type", "2 minutes")} select event_type, start, "end", n_events from runs""",
    "q_user_sessions": f"""with {_sessions("user_id", "1 hour")} select user_id, start, "end", n_events from runs""",
    "q_last_op_per_key": f"""with {_sessions("user_id", "1 hour")} select g.user_id, runs.start, event_type, arg_max(event_id, (ts, event_id)) as op
      from g join runs on g.user_id = runs.user_id and g.s = runs.s group by 1, 2, 3""",
    "q_tumbling_window": """select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 2) as total from events where ts is not null group by 1, 2""",
    "q_sliding_window": """select start, count(*) as n from (select unnest([time_bucket(interval '30 minutes', ts), time_bucket(interval '30 minutes', ts) - interval '30 minutes']) as start
      from events where ts is not null) group by 1""",
}
