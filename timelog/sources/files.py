"""Side tables and sinks in open formats: offsets, snapshots, audit, transactions, policies, the log itself."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from timelog import schema as S
from timelog.functions.running import within


def write_log(log: DataFrame, path: str, mode: str = "append", rows_per_file: int = 1_000_000) -> None:
    """Parquet by partition, in ranges of (partition, offset) that are sorted inside files: partitions of any size are written by many tasks, and statistics of files and row groups prune offset and time scans."""
    _write_ranges(log.repartitionByRange("partition_id", "offset"), path, mode, rows_per_file)


def _write_ranges(ranges: DataFrame, path: str, mode: str, rows_per_file: int = 1_000_000) -> None:
    sorted_rows = ranges.sortWithinPartitions("partition_id", "offset")
    sorted_rows.write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy("partition_id").parquet(path)


def read_log(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A log that write_log has written. With a schema, a log without rows (and so without files) can be read too."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def segment_files(log: DataFrame, from_offset: int) -> DataFrame:
    """The files of a stored log that hold offsets from `from_offset` on, with their ranges and bytes: what a new replica has to copy."""
    at = log.select("partition_id", "offset", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
    found = at.groupBy("partition_id", "path", "bytes").agg(F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"))
    return found.where(F.col("last_offset") >= from_offset)


def append_replicated(log: DataFrame, batch: DataFrame, path: str) -> None:
    """Append a batch whose offsets follow the log's without a gap; else ValueError."""
    ends = log.groupBy("partition_id").agg(F.max("offset").alias("end"))
    starts = batch.groupBy("partition_id").agg(F.min("offset").alias("first"), F.max("offset").alias("last"), F.count_distinct("offset").alias("n"))
    bad = starts.join(ends, "partition_id", "left").where((F.col("first") != F.coalesce("end", F.lit(-1)) + 1) | (F.col("last") - F.col("first") + 1 != F.col("n")))
    if not bad.isEmpty():
        raise ValueError("the batch does not follow the log without a gap")
    write_log(batch, path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.AUDIT).json(path)


def write_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.TX_RECORD).json(path)


def read_snapshots(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """Snapshots of the version that this code understands."""
    return spark.read.schema(S.SNAPSHOT).json(path).where(F.col("version") == version)


def snapshot(log: DataFrame, offsets: DataFrame, version: int = 1) -> DataFrame:
    """One row per partition: high watermark and group offsets."""
    marks = log.groupBy("partition_id").agg(F.max("offset").alias("high_watermark"))
    groups = offsets.groupBy("partition_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("group_id", "committed")))).alias("group_offsets"))
    return marks.join(groups, "partition_id", "left").select(F.lit(version).alias("version"), "partition_id", "high_watermark", F.col("high_watermark").alias("last_scheduled"), "group_offsets")


def backup(log: DataFrame, segs: DataFrame, path: str) -> None:
    """Write the rows of some segments to a backup, which grows by one folder each time."""
    write_log(within(log, "offset", segs.select("partition_id", "first_offset", "last_offset"), ["partition_id"], "first_offset", "last_offset"), path)


def restore(spark: SparkSession, path: str, to: str, schema: StructType | None = None) -> None:
    """Write a log from its backups; rows that several of them hold stand once."""
    # Ranges of (partition, offset) hold all copies of a row, so one shuffle serves to find them and to write.
    ranges = read_log(spark, path, schema).repartitionByRange("partition_id", "offset")
    _write_ranges(ranges.dropDuplicates(["partition_id", "offset"]), to, "overwrite")


def write_checkpoints(marks: DataFrame, path: str) -> None:
    """The last offset of each partition whose timer is set (partition_id, last_scheduled)."""
    marks.select("partition_id", "last_scheduled").write.mode("overwrite").json(path)


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """Timer checkpoints; records that can't be read, or whose offset is below 0, count as none."""
    return spark.read.schema("partition_id int, last_scheduled long").json(path).where(F.col("partition_id").isNotNull() & (F.col("last_scheduled") >= 0))


def read_policy(spark: SparkSession, path: str) -> DataFrame:
    """(subject, topic, actions) from JSON lines {subject, grants: [{topic, actions}]}."""
    rows = spark.read.schema("subject string, grants array<struct<topic:string,actions:array<string>>>").json(path)
    return rows.select("subject", F.explode("grants").alias("g")).select("subject", "g.*")


def disk_usage(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def wal_files(files: DataFrame) -> DataFrame:
    """Rows of (path, ...) that are log segments outside protected folders."""
    return files.where(F.col("path").rlike(r"\.(log|wal)$") & ~F.col("path").rlike(r"(^|/)(raft|snapshots?|checkpoints?)/"))


def kafka_sink(feed: DataFrame, servers: str, topic: str):
    """A streaming write of (key, value) to Kafka; needs the connector on the class path."""
    return feed.selectExpr("CAST(key AS STRING) AS key", "value").writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)


def webhook(url: str, timeout: float = 10.0, attempts: int = 3) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that posts each partition's rows as JSON; a status of 300 or above fails the task after `attempts`."""

    def post(rows) -> None:
        import time

        lines = [json.loads(r["value"]) for r in rows]
        if not lines:
            return
        request = urllib.request.Request(url, json.dumps(lines).encode(), {"Content-Type": "application/json"}, method="POST")
        for n in range(attempts):
            try:
                with urllib.request.urlopen(request, timeout=timeout) as answer:
                    if answer.status < 300:
                        return
            except OSError:
                pass
            time.sleep(0.1 * 2**n)
        raise RuntimeError(f"{url} did not take the batch")

    return lambda batch, _: batch.select("value").foreachPartition(post)


def fan_out_sinks(*sinks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """One foreachBatch function that writes to several sinks."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        for sink in sinks:
            sink(batch, epoch)
        batch.unpersist()

    return write
