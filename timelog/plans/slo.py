"""Latency, errors, throughput."""

from pyspark.sql import functions as F

from timelog.functions.scalars import LATENCY_BOUNDS
from timelog.operators import slo
from timelog.plans.registry import query
from timelog.sources import log as L

_CASE = "CASE " + " ".join(f"WHEN latency_us <= {b} THEN {i}" for i, b in enumerate(LATENCY_BOUNDS)) + " ELSE 16 END"
_BOUND = "list_extract([" + ", ".join(map(str, (*LATENCY_BOUNDS, LATENCY_BOUNDS[-1]))) + "], bucket + 1)"
_HIST = f""", h AS (SELECT topic, {_CASE} AS bucket, count(*) AS n, count(*) FILTER (topic = 'error') AS errors FROM ev GROUP BY 1, 2),
  c AS (SELECT *, sum(n) OVER (PARTITION BY topic ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY topic) AS total FROM h) """


def _obs(spark, d):
    return L.from_events(spark, d).select("topic", "latency_us", (F.col("topic") == "error").alias("is_error"), "schedule_ts", F.timestamp_millis("schedule_ts").alias("at"))


def _rank(p: float) -> str:
    return f"CAST((SELECT min({_BOUND}) FROM c WHERE c.topic = t.topic AND upto >= greatest(1, least(total, floor({p} * (total - 1)) + 1))) AS BIGINT)"


@query("slo_histogram", _HIST + "SELECT topic, CAST(bucket AS INTEGER) AS bucket, n, errors FROM h")
def slo_histogram(spark, d):
    return slo.histogram(_obs(spark, d), ["topic"])


@query("slo_percentiles", _HIST + f"SELECT topic, CAST(sum(n) AS BIGINT) AS requests, CAST(sum(errors) AS BIGINT) AS errors, {_rank(0.95)} AS p95_us, {_rank(0.99)} AS p99_us FROM h t GROUP BY topic")
def slo_percentiles(spark, d):
    return slo.percentiles(_obs(spark, d), ["topic"], {"p95_us": 0.95, "p99_us": 0.99})


@query("slo_compliance", _HIST + f"SELECT topic, p99_us, error_rate, error_rate <= 0.01 AND p99_us <= 500000 AS compliant FROM (SELECT topic, {_rank(0.99)} AS p99_us, round(sum(errors) / sum(n), 6) AS error_rate FROM h t GROUP BY topic)")
def slo_compliance(spark, d):
    return slo.compliance(_obs(spark, d), ["topic"], 500_000, 0.01)


@query("error_rates", "SELECT user_id % 10 AS shard, count(*) AS requests, round(count(*) FILTER (topic = 'error') / count(*), 6) AS error_rate FROM ev GROUP BY 1")
def error_rates(spark, d):
    rows = L.from_events(spark, d).select((F.col("meta")["partition_key"].cast("long") % 10).alias("shard"), (F.col("topic") == "error").alias("is_error"))
    return slo.error_rate(rows, ["shard"])


@query(
    "slo_windowed",
    "SELECT schedule_ts // 3600000 * 3600000 AS window_start, topic, count(*) AS requests, count(*) FILTER (topic = 'error') AS errors, max(latency_us) AS worst_us FROM ev GROUP BY 1, 2",
)
def slo_windowed(spark, d):
    return slo.windowed(_obs(spark, d), "at", "1 hour", ["topic"])


@query(
    "exact_percentiles",
    ", s AS (SELECT topic, list(latency_us ORDER BY latency_us) AS xs, count(*) AS n, min(latency_us) AS least, max(latency_us) AS most, round(avg(latency_us), 6) AS mean FROM ev GROUP BY topic) SELECT topic, "
    + ", ".join(f"xs[CAST(floor((n - 1) * {p} / 100.0) AS BIGINT) + 1] AS p{p}" for p in (50, 95, 99))
    + ", least, most, mean FROM s",
)
def exact_percentiles(spark, d):
    return slo.exact_percentiles(_obs(spark, d), ["topic"], "latency_us")


@query(
    "throughput_by_topic",
    "SELECT topic, count(*) AS events, round(count(*) / ((max(schedule_ts) - min(schedule_ts)) / 1000.0), 6) AS per_second, round(count(*) FILTER (topic <> 'error') / count(*), 6) AS success_rate FROM ev GROUP BY topic",
)
def throughput_by_topic(spark, d):
    return slo.throughput(_obs(spark, d), ["topic"], "schedule_ts")


@query(
    "rate_per_minute",
    "SELECT schedule_ts // 60000 * 60000 AS minute, round(count(*) / 60.0, 6) AS per_second FROM ev GROUP BY 1",
)
def rate_per_minute(spark, d):
    w = F.window("at", "1 minute")
    return _obs(spark, d).groupBy(F.unix_millis(w["start"]).alias("minute")).agg(F.round(F.count("*") / 60, 6).alias("per_second"))


@query(
    "node_metrics",
    "SELECT partition_id, unnest(['events', 'bytes', 'topics']) AS metric, unnest([count(*), CAST(sum(strlen(props)) AS BIGINT), count(DISTINCT topic)]) AS value FROM log GROUP BY partition_id",
)
def node_metrics(spark, d):
    wide = L.event_log(spark, d).groupBy("partition_id").agg(F.count("*").alias("events"), F.sum(F.length("payload")).cast("long").alias("bytes"), F.count_distinct("topic").alias("topics"))
    return wide.unpivot("partition_id", ["events", "bytes", "topics"], "metric", "value")
