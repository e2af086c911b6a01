"""Latency histograms, bucketed and exact percentiles, error rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timelog.functions.running import with_running
from timelog.functions.scalars import latency_bound, latency_bucket


def histogram(obs: DataFrame, keys: list[str]) -> DataFrame:
    return obs.groupBy(*keys, latency_bucket(F.col("latency_us")).alias("bucket")).agg(F.count("*").alias("n"), F.count_if("is_error").alias("errors"))


def percentiles(obs: DataFrame, keys: list[str], quantiles: dict[str, float]) -> DataFrame:
    """Upper bounds of the buckets that hold the given ranks; all from at most 17 rows per key."""
    hist = histogram(obs, keys)
    up = Window.partitionBy(*keys).orderBy("bucket")
    hist = hist.withColumn("upto", F.sum("n").over(up)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    rank = lambda q: F.greatest(F.lit(1), F.least(F.col("total"), F.floor(F.lit(q) * (F.col("total") - 1)) + 1))
    return hist.groupBy(*keys).agg(
        F.sum("n").alias("requests"), F.sum("errors").alias("errors"), *(latency_bound(F.min(F.when(F.col("upto") >= rank(q), F.col("bucket")))).alias(n) for n, q in quantiles.items())
    )


def error_rate(obs: DataFrame, keys: list[str]) -> DataFrame:
    n = F.count("*")
    return obs.groupBy(*keys).agg(n.alias("requests"), F.round(F.coalesce(F.try_divide(F.count_if("is_error"), n), F.lit(0.0)), 6).alias("error_rate"))


def compliance(obs: DataFrame, keys: list[str], target_p99_us: int, max_error_rate: float) -> DataFrame:
    """Within the error rate and, if there is a target, the 99th percentile."""
    out = percentiles(obs, keys, {"p99_us": 0.99}).withColumn("error_rate", F.round(F.col("errors") / F.col("requests"), 6))
    ok = F.col("error_rate") <= max_error_rate
    if target_p99_us > 0:
        ok = ok & (F.col("p99_us") <= target_p99_us)
    return out.select(*keys, "p99_us", "error_rate", ok.alias("compliant"))


def exact_percentiles(obs: DataFrame, keys: list[str], value: str, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """sorted[floor((n - 1) * p / 100)] with minimum, maximum and mean, from counts of equal values."""
    counts = obs.groupBy(*keys, value).agg(F.count("*").alias("n"))
    upto = with_running(counts, keys, value, [], {"upto": F.col("n")}, block=1 << 12)
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor((F.col("total") - 1) * p / 100), F.col(value)))
    mean = F.round(F.sum(F.col(value) * F.col("n")) / F.sum("n"), 6)
    return upto.join(totals, keys).groupBy(*keys).agg(*(at(p).alias(f"p{p}") for p in percents), F.min(value).alias("least"), F.max(value).alias("most"), mean.alias("mean"))


def windowed(obs: DataFrame, time: str, width: str, keys: list[str]) -> DataFrame:
    """Tumbling windows with requests, errors and bytes per second."""
    w = F.window(time, width)
    return obs.groupBy(F.unix_millis(w["start"]).alias("window_start"), *keys).agg(F.count("*").alias("requests"), F.count_if("is_error").alias("errors"), F.max("latency_us").alias("worst_us"))


def throughput(obs: DataFrame, keys: list[str], time_ms: str) -> DataFrame:
    span = (F.max(time_ms) - F.min(time_ms)) / 1000
    return obs.groupBy(*keys).agg(
        F.count("*").alias("events"), F.round(F.try_divide(F.count("*"), span), 6).alias("per_second"), F.round(F.count_if(~F.col("is_error")) / F.count("*"), 6).alias("success_rate")
    )
