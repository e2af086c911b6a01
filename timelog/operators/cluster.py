"""What the cluster decides: ring ownership, replicas, failover, lag, quorum and health."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timelog.functions import scalars as X


def ring(spark: SparkSession, nodes: DataFrame, virtual: int = 50) -> DataFrame:
    """(pos, node_id, rack) of each node's virtual points."""
    points = nodes.select("node_id", "rack", F.explode(F.sequence(F.lit(0), F.lit(virtual - 1))).alias("v"))
    return points.select(X.ring_position(F.concat_ws("#", "node_id", F.col("v").cast("string"))).alias("pos"), "node_id", "rack")


def _located(keys: DataFrame, points: DataFrame, key: str, buckets: int = 256) -> DataFrame:
    """Adds point: the first ring point (a struct of all columns of `points`) at or after each key's position, round the ring.

    Positions are spread over buckets of the leading byte; a key meets its
    bucket's points and the first point after the bucket, an equi-join instead
    of a theta join.
    """
    bucket = lambda pos: F.conv(F.substring(pos, 1, 2), 16, 10).cast("int")
    each = F.struct("pos", *(c for c in points.columns if c != "pos"))
    # Per bucket: its points in order, and the first point of any later bucket, else the ring's first.
    by_bucket = points.withColumn("b", bucket(F.col("pos"))).groupBy("b").agg(F.array_sort(F.collect_list(each)).alias("own"))
    later = Window.orderBy("b").rowsBetween(1, Window.unboundedFollowing)
    all_buckets = points.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(by_bucket, "b", "left")
    first = F.get("own", F.lit(0))
    table = all_buckets.select("b", "own", F.coalesce(F.min(first).over(later), F.min(first).over(Window.partitionBy())).alias("next"))
    h = keys.withColumn("h", X.ring_position(F.col(key))).withColumn("b", bucket(F.col("h"))).join(table, "b")
    own = F.get(F.filter("own", lambda p: p["pos"] >= F.col("h")), F.lit(0))
    return h.withColumn("point", F.coalesce(own, F.col("next"))).drop("h", "b", "own", "next")


def owners(keys: DataFrame, points: DataFrame, key: str = "key") -> DataFrame:
    """Adds owner: the node of the first ring point at or after each key's position."""
    return _located(keys, points.select("pos", "node_id"), key).withColumn("owner", F.col("point.node_id")).drop("point")


def replicas(keys: DataFrame, points: DataFrame, n: int, key: str = "key") -> DataFrame:
    """Adds replicas: `n` distinct nodes clockwise from each key, one per rack if there are more than `n` nodes.

    The walk is done once from each ring point, not from each key: points are 50
    for each node of the cluster, and keys look their point up.
    """

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ring = pd.concat([pd.DataFrame({"pos": [], "node_id": [], "rack": []}), *frames]).sort_values("pos")
        spots = list(zip(ring["node_id"], ring["rack"]))
        want, spare, out = min(n, len(set(ring["node_id"]))), len(set(ring["node_id"])) > n, []
        for at in range(len(spots)):
            ids, racks = [], set()
            for node, rack in (spots[(at + k) % len(spots)] for k in range(len(spots))):
                if node not in ids and not (spare and rack and rack in racks):
                    ids.append(node)
                    racks.add(rack)
                    if len(ids) == want:
                        break
            out.append(ids)
        yield pd.DataFrame({"pos": ring["pos"], "replicas": out})

    walked = points.select("pos", "node_id", "rack").repartition(1).mapInPandas(walk, "pos string, replicas array<string>")
    return _located(keys, walked, key).withColumn("replicas", F.col("point.replicas")).drop("point")


def assignment_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per partition: replicas added and removed, and whether the leader moved."""
    o, n = (df.select("partition_id", F.col("leader_id").alias(f"{p}_leader"), F.col("replicas").alias(f"{p}_replicas")) for df, p in ((old, "old"), (new, "new")))
    none = F.array().cast("array<string>")
    out = o.join(n, "partition_id", "full_outer")
    a, b = F.coalesce("old_replicas", none), F.coalesce("new_replicas", none)
    return out.select(
        "partition_id",
        F.array_join(F.array_sort(F.array_except(b, a)), ",").alias("added"),
        F.array_join(F.array_sort(F.array_except(a, b)), ",").alias("removed"),
        (~F.col("old_leader").eqNullSafe(F.col("new_leader"))).alias("leader_moved"),
    )


def failover(assignments: DataFrame, alive: DataFrame) -> DataFrame:
    """New leader: among live in-sync replicas other than the old leader, else such replicas, the greatest offset, then the least id; null if none lives."""
    spread = assignments.select("partition_id", "leader_id", F.explode("replicas").alias("node_id"), "isr", "replica_offsets")
    spread = spread.where(~F.col("node_id").eqNullSafe(F.col("leader_id")))
    live = spread.join(alive.select("node_id"), "node_id", "left_semi")
    rank = F.struct(F.array_contains("isr", F.col("node_id")).cast("int").alias("in_sync"), F.coalesce(F.col("replica_offsets")[F.col("node_id")], F.lit(0)).alias("at"))
    best = live.groupBy("partition_id").agg(F.max(rank).alias("best"))
    chosen = live.withColumn("rank", rank).join(best, "partition_id").where(F.col("rank") == F.col("best")).groupBy("partition_id").agg(F.min("node_id").alias("new_leader"))
    return assignments.select("partition_id").join(chosen, "partition_id", "left")


def under_replicated(assignments: DataFrame, alive: DataFrame, factor: int) -> DataFrame:
    """Partitions with fewer than `factor` live in-sync replicas."""
    spread = assignments.select("partition_id", F.explode("isr").alias("node_id")).join(alive.select("node_id"), "node_id", "left_semi")
    n = spread.groupBy("partition_id").agg(F.count("*").alias("live_isr"))
    out = assignments.select("partition_id").join(n, "partition_id", "left").withColumn("live_isr", F.coalesce("live_isr", F.lit(0)))
    return out.where(F.col("live_isr") < factor)


def replication_lag(assignments: DataFrame, marks: DataFrame) -> DataFrame:
    """Each follower's distance from its leader's high watermark."""
    spread = assignments.select("partition_id", "leader_id", "isr", F.explode("replica_offsets").alias("node_id", "at")).where(F.col("node_id") != F.col("leader_id"))
    out = spread.join(marks.select("partition_id", "hwm"), "partition_id")
    return out.select("partition_id", "node_id", F.greatest(F.col("hwm") - F.col("at"), F.lit(0)).alias("lag"), F.array_contains("isr", F.col("node_id")).alias("in_sync"))


def replication_marks(assignments: DataFrame) -> DataFrame:
    """The least offset of in-sync followers, 0 without any."""
    spread = assignments.select("partition_id", "leader_id", "isr", F.explode("replica_offsets").alias("node_id", "at"))
    counted = F.array_contains("isr", F.col("node_id")) & (F.col("node_id") != F.col("leader_id"))
    return spread.groupBy("partition_id").agg(F.coalesce(F.min(F.when(counted, F.col("at"))), F.lit(0)).alias("replication_hwm"))


def quorum(acks: DataFrame, keys: list[str], min_isr: int) -> DataFrame:
    n = F.count_if("ok") + 1
    return acks.groupBy(*keys).agg(n.alias("acks"), (n >= max(min_isr, 1)).alias("committed"))


def topology(assignments: DataFrame, nodes: DataFrame) -> DataFrame:
    """Partitions with their leader's address and whether it lives."""
    n = nodes.select(F.col("node_id").alias("leader_id"), "address", "rack", (F.col("state") == "alive").alias("leader_alive"))
    out = assignments.select("partition_id", "leader_id", F.size("replicas").alias("n_replicas"), F.size("isr").alias("n_isr")).join(n, "leader_id", "left")
    return out.withColumn("leader_alive", F.coalesce("leader_alive", F.lit(False)))


def cluster_stats(assignments: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("state") == "alive").alias("alive"))
    p = assignments.agg(F.count("*").alias("partitions"), F.count_distinct("leader_id").alias("leaders"))
    return n.crossJoin(p)  # one row each


def member_states(nodes: DataFrame, now: int, heartbeat_ms: int = 1000) -> DataFrame:
    silent = F.lit(now) - F.col("last_seen")
    return nodes.select("node_id", X.member_state(silent, heartbeat_ms).alias("state"), X.clock_skewed(F.col("clock"), F.lit(now)).alias("skewed"))


def same_members(a, b):
    """Equality of two arrays as sets."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))
