"""The event log as a DataFrame: building it, scans, seeks and pages."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from timelog.functions import scalars as X
from timelog.functions.running import with_rank, with_running
from timelog.shared import shared_dir
from timelog.sources import files

PARTITIONS = 8


def from_events(spark: SparkSession, sf_dir: str, partitions: int = PARTITIONS) -> DataFrame:
    """The `events` table as arriving messages, routed to partitions but without offsets."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    raw = ev.select(
        F.col("event_id").alias("arrival"),
        F.concat(F.lit("evt-"), F.col("event_id").cast("string")).alias("message_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("schedule_ts"),
        F.col("props").cast("binary").alias("payload"),
        F.col("event_type").alias("topic"),
        F.create_map(F.lit("partition_key"), F.col("user_id").cast("string")).alias("meta"),
        F.floor(F.col("value") * 1000).cast("long").alias("latency_us"),
    )
    return route(raw, partitions)


def from_orders(spark: SparkSession, sf_dir: str, partitions: int = PARTITIONS) -> DataFrame:
    """`orders` as a second log: key o_custkey, scheduled at o_orderdate."""
    raw = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("arrival"),
        F.concat(F.lit("ord-"), F.col("o_orderkey").cast("string")).alias("message_id"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("schedule_ts"),
        F.col("o_orderpriority").cast("binary").alias("payload"),
        F.col("o_orderstatus").alias("topic"),
        F.create_map(F.lit("partition_key"), F.col("o_custkey").cast("string")).alias("meta"),
    )
    return route(raw, partitions)


def route(raw: DataFrame, partitions: int) -> DataFrame:
    return raw.withColumn("partition_id", X.partition_of(X.partition_key(F.col("meta"), F.col("message_id")), partitions))


def assign_offsets(routed: DataFrame, base: int = 0) -> DataFrame:
    """Dense offsets from `base`, per partition in order of arrival."""
    return with_rank(routed, ["partition_id"], "arrival", "offset", ["message_id"]).withColumn("offset", F.col("offset") + base)


def _version(spark: SparkSession, path: str) -> str:
    """Names the files below a path as they are now, by their times and sizes."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files = fs.listFiles(p, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(found)).encode()).hexdigest()


#: Logs that this application has written: (application, version of the events table) -> path and schema.
_STORED: dict[tuple[str, str], tuple[str, StructType]] = {}


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of the events table as a store holds it: published once for each version of the table, and then read with pruning."""
    key = (spark.sparkContext.applicationId, _version(spark, f"{sf_dir}/events.parquet"))
    if key not in _STORED:
        log = assign_offsets(from_events(spark, sf_dir))
        path = f"{shared_dir(spark)}/timelog-log-{key[0]}-{key[1]}"
        files.write_log(log, path, mode="overwrite")
        _STORED[key] = (path, log.schema)
    return files.read_log(spark, *_STORED[key])


def offset_range(log: DataFrame, first: int, last: int, partition: int | None = None) -> DataFrame:
    """Both ends belong to the range."""
    found = log.where(F.col("offset").between(first, last))
    return found if partition is None else found.where(F.col("partition_id") == partition)


def point(log: DataFrame, partition: int, offset: int) -> DataFrame:
    """The row at an offset; no rows if there is none."""
    return log.where((F.col("partition_id") == partition) & (F.col("offset") == offset))


def time_range(log: DataFrame, start: int, end: int, partition: int | None = None) -> DataFrame:
    """Both ends belong to the range; it tests schedule_ts."""
    found = log.where(F.col("schedule_ts").between(start, end))
    return found if partition is None else found.where(F.col("partition_id") == partition)


def replay_offsets(log: DataFrame, partition: int, start: int, count: int = 0) -> DataFrame:
    """`count` rows from an offset on, 1000 if not positive."""
    count = count if count > 0 else 1000
    return offset_range(log, start, start + count - 1, partition)


def replay_times(log: DataFrame, partition: int, start: int, end: int | None, now: int) -> DataFrame:
    """A missing end means now; rows are numbered in order of offset."""
    return with_rank(time_range(log, start, now if end is None else end, partition), ["partition_id"], "offset", "seq")


def cold_scan(log: DataFrame, start: int, end: int) -> DataFrame:
    """(schedule_ts, offset) entries of a time range in that order."""
    return time_range(log, start, end).select("partition_id", "schedule_ts", "offset").orderBy("schedule_ts", "offset", "partition_id")


def seek(log: DataFrame, since: int, now: int) -> DataFrame:
    """Per partition: earliest and latest positions, and the first offset scheduled in [since, now], else latest."""
    return log.groupBy("partition_id").agg(
        F.min("offset").alias("earliest"),
        (F.max("offset") + 1).alias("latest"),
        F.coalesce(F.min(F.when(F.col("schedule_ts").between(since, now), F.col("offset"))), F.max("offset") + 1).alias("at_time"),
    )


#: Offsets of a read for a remote region; both ends count, so a batch has one more.
FETCH_BATCH = 100


def fetch(log: DataFrame, partition: int, start: int, budget: int = 10 << 20) -> DataFrame:
    """What a remote region gets that asks for a partition from an offset on: batch, and each batch's has_more.

    Batches read the offsets [at, at + FETCH_BATCH], go on after the last row
    sent, and end with the one that brings the payload bytes sent to `budget`.
    Offsets of a log are dense, so a row's batch follows from its offset.
    """
    rows = log.where((F.col("partition_id") == partition) & (F.col("offset") >= start))
    rows = rows.withColumn("batch", F.floor((F.col("offset") - start) / (FETCH_BATCH + 1)).cast("long"))
    totals = rows.groupBy("batch").agg(F.sum(F.length("payload")).alias("bytes"), F.count("*").alias("n"))
    sent = with_running(totals, [], "batch", [], {"upto": F.col("bytes")})
    # has_more peeks at the batch from at + FETCH_BATCH on, whose first row has been sent already if the batch is full.
    more = (F.col("upto") < budget) & (F.col("n") == FETCH_BATCH + 1)
    kept = sent.where(F.col("upto") - F.col("bytes") < budget).select("batch", more.alias("has_more"))
    return rows.join(kept, "batch")


def sync_page(log: DataFrame, partition: int, start: int, budget: int) -> DataFrame:
    """Rows from an offset on while the bytes so far stay within the budget; the first row always."""
    rows = log.where((F.col("partition_id") == partition) & (F.col("offset") >= start))
    out = with_running(rows, ["partition_id"], "offset", [], {"upto": F.length("payload").cast("long")})
    return out.where((F.col("upto") <= budget) | (F.col("offset") == start))
