"""Publishing: validation, admission, access and first-wins dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelog.functions.running import with_highest_before

MAX_ID, MAX_TOPIC, MAX_PAYLOAD = 128, 255, 4 << 20


def reject_reason(id_: Column, topic: Column, payload: Column, schedule_ts: Column) -> Column:
    """The first rule that fails, or null."""
    size = F.octet_length
    return (
        F.when(size(F.coalesce(id_, F.lit(""))) == 0, "message_id empty")
        .when(size(id_) > MAX_ID, "message_id too long")
        .when(size(topic) > MAX_TOPIC, "topic too long")
        .when(size(payload) > MAX_PAYLOAD, "payload too large")
        .when(F.coalesce(schedule_ts, F.lit(0)) <= 0, "schedule_ts not positive")
        .when(F.coalesce(size(payload), F.lit(0)) == 0, "payload empty")
    )


def validated(rows: DataFrame) -> DataFrame:
    return rows.withColumn("reject_reason", reject_reason(F.col("message_id"), F.col("topic"), F.col("payload"), F.col("schedule_ts")))


def first_wins(rows: DataFrame) -> DataFrame:
    """Adds duplicate: an earlier arrival of the partition has the message_id. Aggregates first, so a hot id is no hot window."""
    first = rows.groupBy("partition_id", "message_id").agg(F.min("arrival").alias("__first"))
    return rows.join(first, ["partition_id", "message_id"]).withColumn("duplicate", F.col("arrival") > F.col("__first")).drop("__first")


def unseen(batch: DataFrame, claimed: DataFrame) -> DataFrame:
    """First arrivals of the batch whose message_id no claimed row of the partition has."""
    fresh = batch.join(claimed.select("partition_id", "message_id"), ["partition_id", "message_id"], "left_anti")
    return first_wins(fresh).where("not duplicate").drop("duplicate")


def summary(rows: DataFrame) -> DataFrame:
    """One row: published, duplicate and error counts, and the range of offsets, -1 if none was published."""
    ok = F.col("reject_reason").isNull() & ~F.col("duplicate")
    return rows.agg(
        F.count_if(ok).alias("published"),
        F.count_if(F.col("reject_reason").isNull() & F.col("duplicate")).alias("duplicates"),
        F.count_if(F.col("reject_reason").isNotNull()).alias("errors"),
        F.coalesce(F.min(F.when(ok, F.col("offset"))), F.lit(-1)).alias("min_offset"),
        F.coalesce(F.max(F.when(ok, F.col("offset"))), F.lit(-1)).alias("max_offset"),
    )


def summary_of_batch(rows: DataFrame) -> DataFrame:
    """As `summary` of a batch that a new log gets, straight from the validated rows: offsets are dense from 0, so counts give their range."""
    bad = F.col("reject_reason").isNotNull()
    # A message_id is one row here; what failed a rule is counted by partition.
    ids = rows.groupBy("partition_id", F.when(~bad, F.col("message_id")).alias("id"), bad.alias("bad")).agg(F.count("*").alias("n"))
    by = ids.groupBy("partition_id").agg(F.count_if(~F.col("bad")).alias("kept"), F.sum(F.when(~F.col("bad"), F.col("n") - 1)).alias("again"), F.sum(F.when(F.col("bad"), F.col("n"))).alias("errors"))
    zero = F.lit(0).cast("long")
    return by.agg(
        F.coalesce(F.sum("kept"), zero).alias("published"),
        F.coalesce(F.sum("again"), zero).alias("duplicates"),
        F.coalesce(F.sum("errors"), zero).alias("errors"),
        F.when(F.max("kept") > 0, 0).otherwise(-1).cast("long").alias("min_offset"),
        F.coalesce(F.max("kept") - 1, F.lit(-1)).cast("long").alias("max_offset"),
    )


def accept_newer(rows: DataFrame, order: str = "arrival") -> DataFrame:
    """Last-write-wins log: a row is kept if its created_ts is above all earlier arrivals of its message_id."""
    out = with_highest_before(rows, ["message_id"], order, "created_ts", "stored_ts")
    return out.withColumn("accepted", F.col("stored_ts").isNull() | (F.col("created_ts") > F.col("stored_ts")))


def newest_state(rows: DataFrame, order: str = "arrival") -> DataFrame:
    """The surviving row of each message_id: greatest created_ts, then earliest arrival."""
    return rows.groupBy("message_id").agg(F.max_by(F.struct("created_ts", order, "payload"), F.struct("created_ts", -F.col(order))).alias("x")).select("message_id", "x.*")


def conflict_counts(rows: DataFrame) -> DataFrame:
    kind = F.when(F.col("stored_ts").isNull(), "no_conflict").when(F.col("accepted"), "lww_replaced").otherwise("lww_kept")
    return accept_newer(rows).groupBy(kind.alias("resolution")).agg(F.count("*").alias("n"))


def once_per_commit(commits: DataFrame) -> DataFrame:
    """The first commit of each commit_id, by seq."""
    return commits.groupBy("commit_id").agg(F.min_by(F.struct(*[c for c in commits.columns if c != "commit_id"]), "seq").alias("x")).select("commit_id", "x.*")


def forward_acks(acks: DataFrame) -> DataFrame:
    """Acks whose next_offset is above all earlier ones of the group and partition."""
    out = with_highest_before(acks, ["group_id", "partition_id"], "seq", "next_offset", "committed")
    return out.where(F.col("committed").isNull() | (F.col("next_offset") > F.col("committed")))


def allowed(rows: DataFrame, policy: DataFrame, action: str) -> DataFrame:
    """Rows whose (subject, topic) the policy grants; `*` grants every topic. An empty policy grants everything."""
    grants = policy.select("subject", "topic", F.explode("actions").alias("action")).where(F.col("action") == action)
    if policy.isEmpty():
        return rows
    exact = rows.join(grants.where("topic <> '*'").select("subject", "topic"), ["subject", "topic"], "left_semi")
    everywhere = grants.where("topic = '*'").select("subject").distinct()
    listed = grants.select("subject", "topic").distinct()
    return exact.unionByName(rows.join(listed, ["subject", "topic"], "left_anti").join(everywhere, "subject", "left_semi"))


def administrators(rows: DataFrame, subjects: DataFrame | None) -> DataFrame:
    """Rows whose subject may administer: `subjects` has subject and admin. An empty table lets everyone; None, no policy at all, lets no one."""
    if subjects is None:
        return rows.limit(0)
    if subjects.isEmpty():
        return rows
    return rows.join(subjects.where("admin").select("subject").distinct(), "subject", "left_semi")


def admitted(depths: DataFrame, count: int, max_ready: int, shed: float, max_wheel: int, max_in_flight: int) -> DataFrame:
    """Adds accept: would each partition take `count` more events? A limit of 0 is none."""
    reject = F.lit(False)
    if max_ready:
        ready = F.col("ready") + count
        reject = reject | (ready > max_ready)
        if shed:
            reject = reject | (ready >= int(max_ready * shed))
    if max_wheel:
        reject = reject | (F.col("wheel") + count > max_wheel)
    if max_in_flight:
        reject = reject | (F.col("in_flight") + count > max_in_flight)
    return depths.withColumn("accept", ~reject)


def writable(rows: DataFrame, assignments: DataFrame, node: str) -> DataFrame:
    """Adds fence: why this node may not write the row's partition, or null."""
    a = assignments.select("partition_id", "leader_id", "epoch", "local_epoch", "splitting", "replicas")
    fence = (
        F.when(F.col("leader_id").isNull(), "unknown partition")
        .when(F.col("splitting"), "splitting")
        .when(~F.array_contains("replicas", node), "not local")
        .when(F.col("leader_id") != node, "not leader")
        .when(F.col("local_epoch") < F.col("epoch"), "stale epoch")
    )
    return rows.join(a, "partition_id", "left").withColumn("fence", fence).drop("leader_id", "epoch", "local_epoch", "splitting", "replicas")


def tenants(limits: DataFrame, usage: DataFrame) -> DataFrame:
    """Every tenant with limits or usage, once."""
    return limits.select("tenant").unionByName(usage.select("tenant")).distinct()


def newest_n(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The n rows last in order, as a bounded log or LRU keeps them."""
    return rows.orderBy(F.desc(order)).limit(n)


def running_checkpoint(saves: DataFrame) -> DataFrame:
    """A checkpoint after each save of a consumer, by seq: it only moves forward."""
    out = with_highest_before(saves, ["consumer"], "seq", "offset", "checkpoint")
    return out.withColumn("checkpoint", F.greatest("checkpoint", "offset"))
