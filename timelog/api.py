"""The log's calls as methods of a store in a folder: publish, replay, groups, administration.

A store is a folder of Parquet tables (log, offsets, dead letters, schemas).
Calls that read return DataFrames; calls that write append files. One writer at
a time: what the log's leader was for a partition, the caller is for a store.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timelog import schema as S
from timelog.operators import delivery, groups, lifecycle, publish, schedule, schemas
from timelog.sources import files
from timelog.sources import log as L


class Store:
    def __init__(self, spark: SparkSession, path: str, partitions: int = L.PARTITIONS, segment_rows: int = 100):
        self.spark, self.path, self.partitions, self.segment_rows = spark, path.rstrip("/"), partitions, segment_rows

    def _table(self, name: str, schema) -> DataFrame:
        """A table of the store; empty until its first write."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(place)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def _append(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("append").parquet(f"{self.path}/{name}")

    # log

    def log(self) -> DataFrame:
        return self._table("log", S.EVENT)

    def publish_batch(self, rows: DataFrame, now: int, subject: str | None = None, policy: DataFrame | None = None) -> DataFrame:
        """Validate, authorise, check schemas, route, drop duplicates, give offsets, append. Returns one row of counts.

        `rows`: arrival, message_id, schedule_ts, payload, topic, meta.
        """
        if policy is not None:
            seen = rows.withColumn("subject", F.lit(subject))
            allowed = publish.allowed(seen, policy, "publish").select("arrival").withColumn("ok", F.lit(True))
            rows = rows.join(allowed, "arrival", "left").withColumn("denied", F.col("ok").isNull()).drop("ok")
        else:
            rows = rows.withColumn("denied", F.lit(False))
        checked = publish.validated(schemas.validated(rows, self.schemas()))
        reason = F.when(F.col("denied"), "not allowed").otherwise(F.coalesce("reject_reason", F.when(~F.col("schema_ok"), "schema")))
        checked = checked.withColumn("reject_reason", reason).drop("schema_ok", "denied")
        routed = L.route(checked.where("reject_reason is null"), self.partitions)
        fresh = publish.unseen(routed, self.log())
        base = self.log().groupBy("partition_id").agg((F.max("offset") + 1).alias("base"))
        placed = L.assign_offsets(fresh).join(base, "partition_id", "left").withColumn("offset", F.col("offset") + F.coalesce("base", F.lit(0)))
        event = placed.select(
            "message_id", "schedule_ts", "payload", "topic", "meta", F.lit(now).cast("long").alias("created_ts"), "offset", "partition_id", F.crc32("payload").alias("checksum"), F.lit(0).cast("long").alias("term")
        )
        total, bad = checked.agg(F.count("*"), F.count("reject_reason")).first()
        # One number per partition, taken before the write; a cached frame would follow the new files.
        tops = [tuple(r) for r in self.log().groupBy("partition_id").agg(F.max("offset")).collect()]
        before = self.spark.createDataFrame(tops, "partition_id int, top long")
        files.write_log(event, f"{self.path}/log")
        new = self.log().join(before, "partition_id", "left").where(F.col("offset") > F.coalesce("top", F.lit(-1)))
        done = new.agg(F.count("*").alias("published"), F.coalesce(F.min("offset"), F.lit(-1)).alias("min_offset"), F.coalesce(F.max("offset"), F.lit(-1)).alias("max_offset"))
        return done.select("published", (F.lit(total - bad) - F.col("published")).alias("duplicates"), F.lit(bad).alias("errors"), "min_offset", "max_offset")

    def replay(self, partition: int, start_ts: int = 0, end_ts: int = 0, start_offset: int = 0, count: int = 0, now: int = 0, speed: float = 0) -> DataFrame:
        """By time if either time is set (a missing end is `now`), else `count` rows by offset. `due_ms` paces a replay at `speed`."""
        if partition < 0:
            raise ValueError("partition_id must not be negative")
        if start_ts > 0 or end_ts > 0:
            rows = L.replay_times(self.log(), partition, start_ts, end_ts if end_ts > 0 else None, now)
        else:
            rows = L.with_rank(L.replay_offsets(self.log(), partition, start_offset, count), ["partition_id"], "offset", "seq")
        step = 10 / speed if speed > 0 and speed != 1 else 0
        return rows.withColumn("due_ms", (F.col("seq") * F.lit(step)).cast("long"))

    def seek(self, since: int, now: int) -> DataFrame:
        return L.seek(self.log(), since, now)

    def live(self, partition: int, from_offset: int) -> DataFrame:
        """A stream that goes on where a replay ended."""
        rows = self.spark.readStream.schema(S.EVENT).parquet(f"{self.path}/log")
        return rows.where((F.col("partition_id") == partition) & (F.col("offset") >= from_offset))

    # groups and delivery

    def offsets(self) -> DataFrame:
        return self._table("offsets", "group_id string, partition_id int, committed long, commit_id string, seq long, batch string")

    def ack(self, commits: DataFrame) -> DataFrame:
        """Append the commits that move their group forward and whose commit_id is new; returns them. Columns as `offsets()`, but for batch."""
        batch = uuid.uuid4().hex
        once = publish.once_per_commit(commits).join(self.offsets().where("commit_id is not null").select("commit_id").distinct(), "commit_id", "left_anti")
        top = self.offsets().groupBy("group_id", "partition_id").agg(F.max("committed").alias("top"))
        ahead = publish.forward_acks(once.withColumnRenamed("committed", "next_offset")).drop("committed").withColumnRenamed("next_offset", "committed")
        new = ahead.join(top, ["group_id", "partition_id"], "left").where(F.col("top").isNull() | (F.col("committed") > F.col("top")))
        self._append(new.select("group_id", "partition_id", "committed", "commit_id", "seq", F.lit(batch).alias("batch")), "offsets")
        return self.offsets().where(F.col("batch") == batch).drop("batch")

    def lag(self, wanted: DataFrame) -> DataFrame:
        """Lag of (group_id, partition_id) pairs."""
        latest = groups.upsert_offsets(self.offsets())
        found = wanted.join(latest, ["group_id", "partition_id"], "left").withColumn("committed", F.coalesce("committed", F.lit(-1)))
        return groups.lag(found, groups.high_watermarks(self.log()))

    def subscribe(self, subscriptions: DataFrame, now: int) -> DataFrame:
        """Deliveries of what is due: one per event and group."""
        return delivery.fan_out(schedule.maturity(self.log(), now).where("tier = 'due'"), subscriptions)

    # schemas

    def schemas(self) -> DataFrame:
        return self._table("schemas", "topic string, version int, type string, definition string")

    def register_schema(self, topic: str, kind: str, definition: str, mode: str = "BACKWARD") -> int:
        """The new version's number; ValueError if it may not follow the latest one."""
        last = schemas.latest(self.schemas().where(F.col("topic") == topic)).first()
        if last and (why := schemas.problems(last["type"], last["definition"], kind, definition, mode)):
            raise ValueError("; ".join(why))
        number = last["version"] + 1 if last else 1
        self._append(self.spark.createDataFrame([(topic, number, kind, definition)], self.schemas().schema), "schemas")
        return number

    # administration

    def segments(self) -> DataFrame:
        return lifecycle.segments(self.log(), self.segment_rows)

    def wal_status(self) -> DataFrame:
        return lifecycle.wal_status(self.segments())

    def partitions_info(self) -> DataFrame:
        every = self.spark.range(self.partitions).select(F.col("id").cast("int").alias("partition_id"))
        return groups.high_watermarks(self.log(), every)

    def scheduler_status(self, now: int) -> DataFrame:
        return schedule.status(self.log(), now)

    def compaction_plan(self) -> DataFrame:
        latest = groups.upsert_offsets(self.offsets())
        return lifecycle.compactable(self.segments(), groups.min_consumed(latest, groups.high_watermarks(self.log())))

    def retention_plan(self, now: int, max_age_ms: int | None = None, max_bytes: int | None = None) -> DataFrame:
        """Segments to drop: by age first, then by size among those that stay."""
        segs = self.segments()
        old = lifecycle.expired_by_age(segs, now, max_age_ms) if max_age_ms else segs.limit(0)
        if not max_bytes:
            return old
        rest = segs.join(old.select("partition_id", "segment_id"), ["partition_id", "segment_id"], "left_anti")
        return old.unionByName(lifecycle.expired_by_size(rest, max_bytes), allowMissingColumns=True)

    def without(self, segments: DataFrame, to: str) -> None:
        """Write the log without some segments to another folder."""
        files.write_log(lifecycle.without_segments(self.log(), segments).select(S.EVENT.fieldNames()), f"{to}/log", mode="overwrite")

    def maintain(self, to: str, now: int, max_age_ms: int | None = None, max_bytes: int | None = None) -> dict[str, int]:
        """One pass of the periodic jobs: the log without what retention and compaction allow to go is written to the folder `to`, with a snapshot. Returns how many segments went, by job."""
        old = self.retention_plan(now, max_age_ms, max_bytes).select("partition_id", "segment_id", "first_offset", "last_offset")
        done = self.compaction_plan().select("partition_id", "segment_id", "first_offset", "last_offset")
        counts = {"expired": old.count(), "compacted": done.join(old, ["partition_id", "segment_id"], "left_anti").count()}
        left = lifecycle.without_segments(self.log(), old.unionByName(done).distinct())
        files.write_log(left.select(S.EVENT.fieldNames()), f"{to}/log", mode="overwrite")
        files.snapshot(self.log(), groups.upsert_offsets(self.offsets())).write.mode("overwrite").json(f"{to}/snapshot")
        return counts

    def split(self, partition: int, from_offset: int, key: str, new_partition: int) -> None:
        rows = lifecycle.split(self.log(), partition, from_offset, key, new_partition).drop("source_offset")
        files.write_log(rows.select(S.EVENT.fieldNames()), f"{self.path}/log")

    def append_replicated(self, batch: DataFrame) -> None:
        files.append_replicated(self.log(), batch, f"{self.path}/log")
