"""Scheduling: what is due, hot or cold at an instant, and the order in which it becomes due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelog.functions import scalars as X

HOT_MS = 3_600_000


def tier(schedule_ts: Column, now: int, hot_ms: int = HOT_MS) -> Column:
    return F.when(schedule_ts <= now, "due").when(schedule_ts <= now + hot_ms, "hot").otherwise("cold")


def maturity(log: DataFrame, now: int, hot_ms: int = HOT_MS) -> DataFrame:
    return log.withColumn("tier", tier(F.col("schedule_ts"), now, hot_ms))


def tier_counts(log: DataFrame, now: int, hot_ms: int = HOT_MS) -> DataFrame:
    return maturity(log, now, hot_ms).groupBy("partition_id", "tier").agg(F.count("*").alias("n"), F.min("schedule_ts").alias("first_ts"))


def hydrate(cold: DataFrame, log: DataFrame, now: int, hot_ms: int = HOT_MS, lookahead_ms: int = 10_000) -> DataFrame:
    """Events whose cold entries fall in the window that opens when they turn hot."""
    lookahead_ms = max(lookahead_ms, 10_000)
    due = cold.where(F.col("schedule_ts").between(now + hot_ms, now + hot_ms + lookahead_ms)).select("partition_id", "offset")
    return due.join(log, ["partition_id", "offset"])


def status(log: DataFrame, now: int) -> DataFrame:
    """Pending and ready counts, and delays of the pending."""
    pending = F.col("schedule_ts") > now
    delay = F.when(pending, F.col("schedule_ts") - now)
    return log.groupBy("partition_id").agg(
        F.count_if(pending).alias("active"), F.count_if(~pending).alias("ready"), F.max(delay).alias("max_delay_ms"), F.floor(F.sum(delay) / F.count(delay)).alias("avg_delay_ms")
    )


def wheel(log: DataFrame, now: int, tick: int = 10, size: int = 512, levels: int = 5) -> DataFrame:
    """The wheel level and slot of every pending timer at `now`; level `levels` is too far ahead."""
    delay = F.greatest(F.col("schedule_ts") - now, F.lit(0))
    out = log.where(F.col("schedule_ts") > now).withColumn("level", X.wheel_level(delay, tick, size, levels))
    return out.withColumn("slot", X.wheel_slot(delay, F.col("level"), tick, size, levels))


def recovered(log: DataFrame, checkpoints: DataFrame, now: int) -> DataFrame:
    """Timers to set again after a crash: rows past each partition's last scheduled offset (all rows without a checkpoint), and whether they are ready or still to wait."""
    last = checkpoints.select("partition_id", F.col("last_scheduled").alias("__last"))
    rows = log.join(last, "partition_id", "left").where(F.col("offset") > F.coalesce("__last", F.lit(-1))).drop("__last")
    return rows.withColumn("route", F.when(F.col("schedule_ts") <= now, "ready").otherwise("timer"))


def health(log: DataFrame, segs: DataFrame, now: int, hot_ms: int = HOT_MS, errors: DataFrame | None = None) -> DataFrame:
    """Per partition: high watermark, segments, timers in the wheel, ready events, cold entries, and whether its replay failed and why."""
    tiers = maturity(log, now, hot_ms)
    count = lambda name: F.count_if(F.col("tier") == name)
    out = tiers.groupBy("partition_id").agg(F.max("offset").alias("high_watermark"), count("hot").alias("active_timers"), count("due").alias("ready_events"), count("cold").alias("cold_entries"))
    out = out.join(segs.groupBy("partition_id").agg(F.count("*").alias("segments")), "partition_id", "left")
    if errors is not None:
        out = out.join(errors.select("partition_id", F.col("error").alias("last_error")), "partition_id", "left")
    else:
        out = out.withColumn("last_error", F.lit(None).cast("string"))
    return out.withColumn("replay_error", F.col("last_error").isNotNull())


def batches(log: DataFrame, size: int = 100) -> DataFrame:
    """Delivery batches of `size` events per partition, in order of offset (dense)."""
    return log.withColumn("batch_id", F.floor(F.col("offset") / size).cast("long"))
