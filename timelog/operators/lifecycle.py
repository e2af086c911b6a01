"""Segments and their lives: rotation, retention, compaction, splitting, recovery, backup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelog.functions.running import stretches, with_rank, with_running
from timelog.functions.scalars import key_in_bounds, partition_key


def segments(log: DataFrame, rows: int = 100) -> DataFrame:
    """Segments of `rows` offsets: their ranges and bytes. Time stands in for creation."""
    return log.groupBy("partition_id", F.floor(F.col("offset") / rows).cast("long").alias("segment_id")).agg(
        F.min("offset").alias("first_offset"),
        F.max("offset").alias("last_offset"),
        F.min("schedule_ts").alias("created_ts"),
        F.max("schedule_ts").alias("newest_ts"),
        F.max_by("schedule_ts", "offset").alias("last_ts"),
        F.sum(F.length("payload")).alias("size"),
        F.count("*").alias("events"),
    )


def active(segs: DataFrame) -> DataFrame:
    """Adds active: the segment with the greatest first_offset of its partition."""
    top = segs.groupBy("partition_id").agg(F.max("first_offset").alias("__top"))
    return segs.join(top, "partition_id").withColumn("active", F.col("first_offset") == F.col("__top")).drop("__top")


def usage(segs: DataFrame) -> DataFrame:
    return segs.groupBy("partition_id").agg(F.count("*").alias("segments"), F.sum("size").alias("bytes"))


def expired_by_age(segs: DataFrame, now: int, max_age_ms: int) -> DataFrame:
    """Closed segments created before now - max_age_ms."""
    return active(segs).where(~F.col("active") & (F.col("created_ts") < now - max_age_ms)).drop("active")


def expired_by_size(segs: DataFrame, max_bytes: int) -> DataFrame:
    """The oldest closed segments that must go until the total is at most max_bytes."""
    closed = active(segs).where("not active").drop("active")
    out = with_running(closed, [], "created_ts", ["first_offset", "partition_id"], {"upto": F.col("size")})
    total = segs.agg(F.sum("size")).scalar()
    return out.where(total - (F.col("upto") - F.col("size")) > max_bytes).drop("upto")


def compacted_by_offset(segs: DataFrame, up_to: int) -> DataFrame:
    """Closed segments that end before an offset; one that holds only offset 0 stays."""
    return active(segs).where(~F.col("active") & (F.col("last_offset") > 0) & (F.col("last_offset") < up_to)).drop("active")


def compacted_by_time(segs: DataFrame, up_to: int) -> DataFrame:
    """Closed segments whose last event is scheduled before a time; a time of 0 counts as unknown and stays."""
    last = active(segs)
    return last.where(~F.col("active") & (F.col("last_ts") > 0) & (F.col("last_ts") < up_to)).drop("active")


def compactable(segs: DataFrame, min_consumed: DataFrame) -> DataFrame:
    """Closed segments that all groups have consumed; one that holds only offset 0 stays."""
    out = active(segs).join(min_consumed, "partition_id")
    return out.where(~F.col("active") & (F.col("last_offset") > 0) & (F.col("last_offset") < F.col("min_consumed"))).drop("active")


def compacted_by_consumers(segs: DataFrame, consumed: DataFrame, marks: DataFrame) -> DataFrame:
    """Closed segments before the least offset that a consumer of the partition has reached; nothing where none has moved, where one is at the end, and without consumers."""
    least = consumed.groupBy("partition_id").agg(F.min("committed").alias("least")).join(marks.select("partition_id", "hwm"), "partition_id")
    least = least.where((F.col("least") > 0) & (F.col("least") < F.col("hwm"))).select("partition_id", F.col("least").alias("min_consumed"))
    return compactable(segs, least)


def without_segments(log: DataFrame, gone: DataFrame) -> DataFrame:
    """The log without the offsets of the segments in `gone`: what a retention or compaction job writes back."""
    # Segments that follow each other are one range: what jobs remove is a few stretches of a partition.
    runs = stretches(gone, ["partition_id"], "first_offset", "last_offset")
    ranges = runs.groupBy("partition_id").agg(F.array_sort(F.collect_list(F.struct("first_offset", "last_offset"))).alias("__gone"))
    inside = F.exists("__gone", lambda r: F.col("offset").between(r["first_offset"], r["last_offset"]))
    return log.join(ranges, "partition_id", "left").where(F.col("__gone").isNull() | ~inside).drop("__gone")


def split(log: DataFrame, partition: int, from_offset: int, split_key: str, new_partition: int) -> DataFrame:
    """The rows that a new partition gets, with offsets of its own; the source keeps its rows."""
    key = partition_key(F.col("meta"), F.col("message_id"))
    moved = log.where((F.col("partition_id") == partition) & (F.col("offset") >= from_offset) & key_in_bounds(key, F.lit(split_key), F.lit("")))
    moved = moved.withColumnRenamed("offset", "source_offset").withColumn("partition_id", F.lit(new_partition))
    return with_rank(moved, ["partition_id"], "source_offset", "offset")


def valid_prefix(records: DataFrame, bad: Column) -> DataFrame:
    """Records before the first bad one of each partition."""
    first = records.where(bad).groupBy("partition_id").agg(F.min("offset").alias("__bad"))
    return records.join(first, "partition_id", "left").where(F.col("__bad").isNull() | (F.col("offset") < F.col("__bad"))).drop("__bad")


def truncated(log: DataFrame, partition: int, from_offset: int) -> DataFrame:
    """The log without the partition's rows from an offset on."""
    return log.where((F.col("partition_id") != partition) | (F.col("offset") < from_offset))


def gaps(log: DataFrame) -> DataFrame:
    """Per partition: whether offsets are dense from the first to the last. A replicated batch with gaps is refused."""
    return log.groupBy("partition_id").agg(
        F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"), (F.max("offset") - F.min("offset") + 1 - F.count_distinct("offset")).alias("missing")
    )


def backup_set(segs: DataFrame, checkpoint: int) -> DataFrame:
    """Closed segments with rows past the checkpoint."""
    return active(segs).where(~F.col("active") & (F.col("last_offset") > checkpoint)).drop("active")


def wal_status(segs: DataFrame) -> DataFrame:
    return segs.groupBy("partition_id").agg(
        F.min("first_offset").alias("first_offset"),
        F.max("last_offset").alias("last_offset"),
        F.min_by("created_ts", "first_offset").alias("oldest_ts"),
        F.max_by("newest_ts", "first_offset").alias("newest_ts"),
        F.count("*").alias("segments"),
        F.sum("size").alias("bytes"),
    )
