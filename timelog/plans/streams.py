"""Streaming jobs run over all input there is, held against batch answers."""

from pyspark.sql import functions as F

from timelog.functions import scalars as X
from timelog.plans.registry import query
from timelog.streaming import jobs


@query("stream_dedup", "SELECT user_id, topic AS event_type, count(DISTINCT 1) AS n FROM ev GROUP BY 1, 2")
def stream_dedup(spark, d):
    once = jobs.dedup(jobs.stream_events(spark, d), ["user_id", "event_type"], ttl="3650 days")
    return jobs.drain(once, "stream_dedup").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query(
    "stream_slo_window",
    "SELECT schedule_ts // 3600000 * 3600000 AS window_start, count(*) AS n, count(*) FILTER (topic = 'error') AS errors FROM ev GROUP BY 1",
)
def stream_slo_window(spark, d):
    out = jobs.drain(jobs.slo_windows(jobs.stream_events(spark, d), "1 hour"), "stream_slo_window", "complete")
    return out.groupBy(F.unix_millis("window.start").alias("window_start")).agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"))


@query("stream_sliding", "SELECT (schedule_ts // 3600000 - k) * 3600000 AS window_start, topic AS event_type, count(*) AS n FROM ev, range(2) t(k) GROUP BY 1, 2")
def stream_sliding(spark, d):
    out = jobs.drain(jobs.sliding(jobs.stream_events(spark, d), "2 hours", "1 hour"), "stream_sliding", "complete")
    return out.select(F.unix_millis("window.start").alias("window_start"), "event_type", "n")


@query("stream_timers", "SELECT CAST(event_id AS VARCHAR) AS id, schedule_ts + 60000 AS due FROM ev")
def stream_timers(spark, d):
    """Timers that fired and those still pending when the input ends."""
    wheel = jobs.timers(jobs.stream_events(spark, d))
    return wheel.fired().unionByName(wheel.pending())


@query(
    "stream_timers_cancelled",
    """, c AS (SELECT event_id - 1 AS id, min(schedule_ts) AS at FROM ev WHERE event_id % 7 = 0 GROUP BY 1)
    SELECT CAST(event_id AS VARCHAR) AS id, schedule_ts + 86400000 AS due FROM ev LEFT JOIN c ON id = event_id WHERE c.at IS NULL OR c.at >= schedule_ts + 86400000""",
)
def stream_timers_cancelled(spark, d):
    """Every seventh event cancels the timer of the event before it, if that is not due yet."""
    events = jobs.stream_events(spark, d)
    gone = events.where("event_id % 7 = 0").select((F.col("event_id") - 1).cast("string").alias("id"), F.lit(None).cast("long").alias("due"), F.unix_millis("at").alias("at"), F.lit("cancel").alias("kind"))
    wheel = jobs.timers(events, 86_400_000, gone)
    return wheel.fired().unionByName(wheel.pending())


@query("stream_fan_out", "SELECT event_id, 'g' || i AS group_id FROM routed, range(3) t(i) WHERE partition_id % 3 >= i")
def stream_fan_out(spark, d):
    """Deliveries as events stream in: group g(i) subscribes to partitions whose number modulo 3 is i or more."""
    events = jobs.stream_events(spark, d).withColumn("partition_id", X.partition_of(F.col("user_id").cast("string"), 8))
    subs = spark.range(8).select(F.col("id").cast("int").alias("partition_id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("i")).where("partition_id % 3 >= i")
    out = jobs.fan_out(events, subs.select(F.concat(F.lit("g"), F.col("i").cast("string")).alias("group_id"), "partition_id"))
    return jobs.drain(out.select("event_id", "group_id"), "stream_fan_out")


@query("stream_change_feed", "SELECT topic || '/' || partition_id AS key, event_id AS seq FROM routed")
def stream_change_feed(spark, d):
    """The change feed of events as they arrive, by key."""
    events = jobs.stream_events(spark, d).withColumn("partition_id", X.partition_of(F.col("user_id").cast("string"), 8))
    return jobs.drain(events.select(F.concat_ws("/", "event_type", F.col("partition_id").cast("string")).alias("key"), F.col("event_id").alias("seq")), "stream_change_feed")


@query(
    "stream_acks",
    """, a AS (SELECT CAST(event_id AS VARCHAR) AS delivery_id, topic = 'purchase' AS ok, CASE topic WHEN 'error' THEN 5 WHEN 'click' THEN 2 ELSE 1 END AS acks FROM ev)
    SELECT delivery_id, CASE WHEN ok THEN 'acked' ELSE 'dead letter' END AS outcome, CAST(CASE WHEN ok THEN 1 ELSE 5 END AS BIGINT) AS attempts FROM a WHERE ok OR acks = 5""",
)
def stream_acks(spark, d):
    """Purchases are acknowledged, errors refused five times, clicks twice; the last two kinds stay open."""
    events = jobs.stream_events(spark, d)
    n = F.when(F.col("event_type") == "error", 5).when(F.col("event_type") == "click", 2).otherwise(1)
    acks = events.select(
        F.col("event_id").cast("string").alias("delivery_id"), "at", F.explode(F.sequence(F.lit(1), n)).alias("nth"), F.when(F.col("event_type").isin("purchase", "error", "click"), "ack").otherwise("sent").alias("kind"), (F.col("event_type") == "purchase").alias("ok")
    )
    return jobs.drain(jobs.ack_tracking(acks.drop("nth")), "stream_acks")
