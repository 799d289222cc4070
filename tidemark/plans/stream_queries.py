"""Streaming operators, replayed over a table and held against the batch result."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import register
from ..functions.text import tick_size
from ..sources.readers import parquet_table as table
from ..streaming import replay, state


@register("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    s = replay.table_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return replay.replayed(state.first_seen(s, ["user_id", "event_type"], "ts", "3650 days"), "dedup").select("user_id", "event_type")


@register(
    "stream_ewma_state",
    """WITH RECURSIVE n AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE value IS NOT NULL),
 q AS (SELECT user_id, event_id, i, CAST(value AS DOUBLE) AS level FROM n WHERE i = 1 UNION ALL SELECT n.user_id, n.event_id, n.i, q.level + 0.2 * (n.value - q.level) FROM q JOIN n ON n.user_id = q.user_id AND n.i = q.i + 1)
 SELECT user_id, event_id, round(level, 6) AS level FROM q""",
)
def stream_ewma_state(spark, sf_dir):
    s = replay.table_stream(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return replay.replayed(state.ewma_state(s, "user_id", "event_id", "value", 0.2), "ewma").select("user_id", "event_id", F.round("level", 6).alias("level"))


@register(
    "stream_tumbling_counts",
    """WITH w AS (SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL)
 SELECT window_start, event_type, n, round(total, 4) AS total FROM w WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
)
def stream_tumbling_counts(spark, sf_dir):
    """Daily windows that are final when the source ends: those that the watermark has passed."""
    s = replay.table_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    got = replay.replayed(state.tumbling_counts(s, "ts", "1 day", "event_type"), "windows")
    return got.select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


@register(
    "matured_forecasts",
    """SELECT a.user_id, a.event_id, round(b.value - a.value, 6) AS residual FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events) a
 JOIN (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events) b ON a.user_id = b.user_id AND b.i = a.i + 2""",
)
def matured_forecasts(spark, sf_dir):
    """Each event's value as forecast of the value two events on."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.row_number().over(w).alias("i"))
    f = e.select("user_id", "event_id", "i", F.col("value").alias("prediction"), F.lit(2).alias("h"))
    return state.matured(f, e.select("user_id", "i", F.col("value").alias("actual")), ["user_id"], "i", "h").select("user_id", "event_id", F.round("residual", 6).alias("residual"))


@register(
    "tick_sizes",
    """SELECT p_partkey, CASE WHEN p_retailprice < 950 THEN 1.0 WHEN p_retailprice < 1000 THEN 5.0 WHEN p_retailprice < 1500 THEN 10.0 ELSE 50.0 END AS tick, ceil(p_retailprice / CASE WHEN p_retailprice < 950 THEN 1.0 WHEN p_retailprice < 1000 THEN 5.0 WHEN p_retailprice < 1500 THEN 10.0 ELSE 50.0 END) * CASE WHEN p_retailprice < 950 THEN 1.0 WHEN p_retailprice < 1000 THEN 5.0 WHEN p_retailprice < 1500 THEN 10.0 ELSE 50.0 END AS rounded_up FROM part""",
)
def tick_sizes(spark, sf_dir):
    """The step of each price on a ladder of steps, and the price rounded up to it."""
    tick = tick_size(F.col("p_retailprice"), ((950.0, 1.0), (1000.0, 5.0), (1500.0, 10.0), (0.0, 50.0)))
    return table(spark, sf_dir, "part").select("p_partkey", tick.alias("tick"), (F.ceil(F.col("p_retailprice") / tick) * tick).alias("rounded_up"))
