"""Structured Streaming forms of the log operators."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from timelog.functions.scalars import latency_bucket
from timelog.shared import shared_dir

TTL = "168 hours"


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, with event time as `at`."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("at", F.col("ts").cast("timestamp"))


def dedup(events: DataFrame, keys: list[str], time: str = "at", ttl: str = TTL) -> DataFrame:
    """The first row of each key within the ttl."""
    return events.withWatermark(time, ttl).dropDuplicatesWithinWatermark(keys)


def slo_windows(events: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Tumbling windows of requests and errors by latency bucket."""
    obs = events.withColumn("bucket", latency_bucket(F.floor(F.col("value") * 1000))).withColumn("is_error", F.col("event_type") == "error")
    return obs.withWatermark("at", late).groupBy(F.window("at", width), "bucket").agg(F.count("*").alias("n"), F.count_if("is_error").alias("errors"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Extension: session windows per user."""
    return events.withWatermark("at", late).groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n"))


def sliding(events: DataFrame, width: str = "10 minutes", slide: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Extension: sliding windows per event type."""
    return events.withWatermark("at", late).groupBy(F.window("at", width, slide), "event_type").agg(F.count("*").alias("n"))


class Timers:
    """Fires each event once the clock, the latest event time seen, has reached its due time; late ones fire at once, none is lost.

    A stateful operator would drop rows behind its watermark and rewrite a key's
    pending list with every batch. Here pending timers are files of the shared
    folder: what a batch does not fire at once is written once, sorted by due
    time, and an epoch fires the stretch of due times between the clocks of the
    epoch before and its own, which prunes files and row groups. Nothing is
    rewritten, and an epoch that is run again replaces its own files only.

    Rows: id, due, at (event time, ms), kind: `set` or `cancel`. A cancel stops
    the timer of its id if it comes (by event time) before the timer is due.
    """

    ROW = "id string, due long, at long, kind string"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _rows(self, name: str, schema: str, before: int) -> DataFrame:
        """What earlier epochs have written."""
        return self.spark.read.schema(f"{schema}, epoch long").parquet(f"{self.folder}/{name}").where(F.col("epoch") < before)

    def _write(self, rows: DataFrame, name: str, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/epoch={epoch}")

    def _live(self, rows: DataFrame, cancels: DataFrame) -> DataFrame:
        first = cancels.groupBy("id").agg(F.min("at").alias("__cancel"))
        return rows.join(first, "id", "left").where(F.col("__cancel").isNull() | (F.col("__cancel") >= F.col("due"))).select("id", "due")

    def start(self) -> Timers:
        """Epoch -1, so that every table can be read from the first batch on."""
        empty = self.spark.createDataFrame([], self.ROW)
        for name in ("pending", "cancels"):
            self._write(empty.select("id", "due", "at"), name, -1)
        self._write(empty.select("id", "due"), "fired", -1)
        self._write(self.spark.createDataFrame([(None,)], "clock long"), "clocks", -1)
        return self

    def epoch(self, batch: DataFrame, epoch: int) -> None:
        before = self._rows("clocks", "clock long", epoch).agg(F.max("clock")).first()[0]
        now = batch.agg(F.max("at")).first()[0]
        clock = max((x for x in (before, now) if x is not None), default=None)
        self._write(batch.where("kind = 'cancel'").select("id", "due", "at"), "cancels", epoch)
        fresh = batch.where("kind = 'set'").select("id", "due", "at")
        self._write(fresh.where(F.lit(clock is None) | (F.col("due") > F.lit(clock))).sort("due"), "pending", epoch)
        late = F.lit(-(1 << 62) if before is None else before)
        kept = self._rows("pending", "id string, due long, at long", epoch).where((F.col("due") > late) & (F.col("due") <= F.lit(clock))).select("id", "due")
        due = fresh.where(F.col("due") <= F.lit(clock)).select("id", "due").unionByName(kept)
        self._write(self._live(due, self._rows("cancels", "id string, due long, at long", epoch + 1)), "fired", epoch)
        self._write(self.spark.createDataFrame([(clock,)], "clock long"), "clocks", epoch)

    def pending(self) -> DataFrame:
        """Timers that have not fired and are not cancelled: (id, due)."""
        every = 1 << 62
        clock = self._rows("clocks", "clock long", every).agg(F.max("clock")).first()[0]
        rows = self._rows("pending", "id string, due long, at long", every)
        return self._live(rows if clock is None else rows.where(F.col("due") > clock), self._rows("cancels", "id string, due long, at long", every))

    def fired(self) -> DataFrame:
        return self._rows("fired", "id string, due long", 1 << 62).select("id", "due")


def timers(events: DataFrame, delay_ms: int = 60_000, cancels: DataFrame | None = None) -> Timers:
    """Run a timer for each event (event_id, at) over all input there is; `cancels` are rows of Timers.ROW of the same stream."""
    spark = events.sparkSession
    at = F.unix_millis("at")
    rows = events.select(F.col("event_id").cast("string").alias("id"), (at + delay_ms).alias("due"), at.alias("at"), F.lit("set").alias("kind"))
    folder = f"{shared_dir(spark)}/timers-{uuid.uuid4().hex}"
    wheel = Timers(spark, folder).start()
    stream = rows if cancels is None else rows.unionByName(cancels)
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").foreachBatch(wheel.epoch).start().awaitTermination()
    return wheel


def ack_tracking(deliveries: DataFrame, timeout_ms: int = 30_000, max_attempts: int = 5, late: str = "1 day", buckets: int = 4096) -> DataFrame:
    """Rows behind the watermark by more than `late` don't count. A stream of (delivery_id, kind: sent or ack, ok, at) -> one row per delivery that ends: acked, or dead letter after max_attempts timeouts or failures.

    A call of Python for each delivery would cost milliseconds, for its rows and
    again when it times out. State is kept by buckets of deliveries instead,
    each a JSON list of [attempts, due, delivery ids]; a batch rewrites the open
    deliveries of the buckets that it has rows for.
    """

    def track(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        held = json.loads(state.get[0]) if state.exists else []
        failed: dict[str, int] = {}
        acked: set[str] = set()
        for frame in rows:
            for name, says in zip(frame["delivery_id"], frame["says"]):
                failed[name] = failed.get(name, 0) + (says == 1)
                if says == 2:
                    acked.add(name)
        ended, kept = [], {}

        def settle(name: str, attempts: int) -> None:
            if name in acked or attempts >= max_attempts:
                ended.append((name, "acked" if name in acked else "dead letter", attempts + (name in acked)))
            else:
                kept.setdefault((attempts, now + timeout_ms * max(1, attempts)), []).append(name)

        # Rows of a delivery put its timeout off; the others time out once in a batch.
        for attempts, due, names in held:
            for name in names:
                if name in failed:
                    failed[name] += attempts
                elif due < now:
                    settle(name, attempts + 1)
                else:
                    kept.setdefault((attempts, due), []).append(name)
        for name, attempts in failed.items():
            settle(name, attempts)
        if kept:
            state.update((json.dumps([[*at, names] for at, names in kept.items()]),))
            state.setTimeoutTimestamp(min(due for _, due in kept))
        elif state.exists:
            state.remove()
        if ended:
            yield pd.DataFrame(ended, columns=["delivery_id", "outcome", "attempts"])

    says = F.when(F.col("kind") == "ack", F.when(F.col("ok"), 2).otherwise(1)).otherwise(0).alias("says")
    rows = deliveries.withWatermark("at", late).select(F.pmod(F.xxhash64("delivery_id"), F.lit(buckets)).alias("bucket"), "delivery_id", says, "at")
    return rows.groupBy("bucket").applyInPandasWithState(track, "delivery_id string, outcome string, attempts long", "held string", "append", GroupStateTimeout.EventTimeTimeout)


def fan_out(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Stream-static join: one delivery per event and group of its partition."""
    return events.join(subscriptions.select("group_id", "partition_id").distinct(), "partition_id")


def drain(stream: DataFrame, name: str, mode: str = "append", sink: Callable | None = None) -> DataFrame | None:
    """Run a stream over all input there is, and return its rows (or hand the batches to `sink`).

    Batches are written by epoch in the shared folder, so a batch that is run
    again replaces itself; in complete mode the last one is the result.
    """
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        at = 0 if mode == "complete" else epoch
        batch.write.mode("overwrite").parquet(f"{folder}/rows/epoch={at}")

    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/state")
    writer.foreachBatch(sink or write).start().awaitTermination()
    if sink:
        return None
    # One empty epoch beside the others: a stream without input has a result too.
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{folder}/rows/epoch=-1")
    return spark.read.parquet(f"{folder}/rows").select(*stream.columns)
