"""Delivery: fan-out to groups, dead letters, retries and dispatcher statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timelog import schema as S
from timelog.functions import scalars as X


def fan_out(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """One delivery per event and group of its partition: round robin over the group's members in order of id, from the dense offset."""
    members = subscriptions.groupBy("group_id", "partition_id").agg(F.array_sort(F.collect_set("member_id")).alias("ms"))
    out = events.join(members, "partition_id").withColumn("member_id", F.element_at("ms", (F.col("offset") % F.size("ms") + 1).cast("int")))
    sub = X.subscription_id(F.col("group_id"), F.col("partition_id"), F.col("member_id"))
    return out.drop("ms").withColumn("delivery_id", X.delivery_id(sub, F.col("offset")))


def live_dead_letters(entries: DataFrame) -> DataFrame:
    """Entries without a tombstone for their delivery."""
    gone = entries.where("tombstone").select("delivery_id")
    return entries.where("not tombstone").join(gone, "delivery_id", "left_anti")


def append_dead_letters(entries: DataFrame, path: str) -> None:
    """Append failed deliveries to the log of dead letters at `path`."""
    given = {c: F.col(c) for c in entries.columns}
    cols = [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in S.DLQ_ENTRY if f.name != "tombstone"]
    entries.select(*cols, F.lit(False).alias("tombstone")).write.mode("append").json(path)


def append_tombstones(gone: DataFrame, path: str) -> None:
    """Mark deliveries (delivery_id, failed_at: when they went) as retried or removed; their entries stay in the log until it is compacted."""
    append = gone.select("delivery_id", "failed_at", F.lit(True).alias("tombstone"))
    append.write.mode("append").json(path)


def read_dead_letters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.DLQ_ENTRY).json(path)


def compact_dead_letters(spark: SparkSession, path: str, to: str) -> None:
    """Write the live entries of a log to a new folder, which then takes the old one's place."""
    live_dead_letters(read_dead_letters(spark, path)).write.mode("overwrite").json(to)


def dead_letter_stats(live: DataFrame, now: int) -> DataFrame:
    return live.agg(F.count("*").alias("n"), (now - F.min("failed_at")).alias("oldest_ms"), (now - F.max("failed_at")).alias("newest_ms"))


def due_retries(entries: DataFrame, now: int) -> DataFrame:
    """Deliveries whose back-off (attempt times a second) has passed."""
    retry_at = F.col("failed_at") + X.delivery_backoff(F.col("attempts"))
    return entries.withColumn("retry_at", retry_at).where(F.col("retry_at") <= now)


def expired(active: DataFrame, now: int, max_attempts: int = 5) -> DataFrame:
    """Unacknowledged deliveries past their deadline and what becomes of them."""
    late = active.where(F.col("deadline") <= now)
    again = F.col("attempts") < max_attempts
    return late.withColumn("action", F.when(again, "retry").otherwise("dead letter")).withColumn("retry_at", F.when(again, F.lit(now) + X.delivery_backoff(F.col("attempts"))))


def dispatcher_stats(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.agg(
        F.count("*").alias("subscriptions"),
        F.sum("in_use").alias("credits_in_use"),
        F.sum(F.greatest(F.col("credits") - F.col("in_use"), F.lit(0))).alias("credits_available"),
        F.count_if("breaker_open").alias("open_breakers"),
    )


def echo_free(log: DataFrame) -> DataFrame:
    """Rows that did not come from another region."""
    return log.where(F.coalesce(F.col("meta")["source_region"], F.lit("")) == "")


def change_feed(log: DataFrame) -> DataFrame:
    """Change events of the log, keyed topic/partition, as JSON."""
    event = F.struct("message_id", "schedule_ts", F.decode("payload", "UTF-8").alias("payload"), "topic", "offset", "partition_id")
    return log.select(F.concat_ws("/", "topic", F.col("partition_id").cast("string")).alias("key"), "offset", "partition_id", F.to_json(F.struct(F.lit("append").alias("op"), event.alias("event"))).alias("value"))


def read_feed(feed: DataFrame) -> DataFrame:
    """The change events of a feed: key, op and the event's columns; what is no JSON gives nulls."""
    kind = "op string, event struct<message_id:string,schedule_ts:long,payload:string,topic:string,offset:long,partition_id:int>"
    return feed.select("key", F.from_json("value", kind).alias("x")).select("key", "x.op", "x.event.*")
