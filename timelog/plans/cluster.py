"""Replication, failover, ring ownership and membership."""

from pyspark.sql import functions as F

from timelog.operators import cluster as C
from timelog.operators import groups as G
from timelog.plans.registry import NOW, query
from timelog.sources import log as L

#: node-i follows at hwm - partition_id * i; node-2 is out of sync on odd partitions; node-1 is dead.
_ASSIGN = """, a AS (SELECT partition_id, hwm, 'node-' || (partition_id % 3) AS leader_id, partition_id % 2 = 0 AS full_isr FROM marks),
  r AS (SELECT a.*, 'node-' || i AS node_id, hwm - partition_id * i AS at_offset, full_isr OR i < 2 AS in_sync FROM a, range(3) t(i)) """


def _assignments(spark, d):
    marks = G.high_watermarks(L.event_log(spark, d))
    nodes = [F.lit(f"node-{i}") for i in range(3)]
    offsets = F.map_from_arrays(F.array(*nodes), F.array(*(F.col("hwm") - F.col("partition_id") * i for i in range(3))))
    isr = F.when(F.col("partition_id") % 2 == 0, F.array(*nodes)).otherwise(F.array(*nodes[:2]))
    return marks, marks.select("partition_id", F.concat(F.lit("node-"), (F.col("partition_id") % 3).cast("string")).alias("leader_id"), F.array(*nodes).alias("replicas"), isr.alias("isr"), offsets.alias("replica_offsets"))


def _nodes(spark):
    rows = [("node-0", "10.0.0.1:9000", "r0", "alive", NOW - 900, NOW), ("node-1", "10.0.0.2:9000", "r1", "dead", NOW - 20_000, NOW - 6_000), ("node-2", "10.0.0.3:9000", "r0", "alive", NOW - 7_000, NOW + 4_000)]
    return spark.createDataFrame(rows, "node_id string, address string, rack string, state string, last_seen long, clock long")


def _alive(spark):
    return _nodes(spark).where("state = 'alive'").select("node_id")


@query("replication_lag", _ASSIGN + "SELECT partition_id, node_id, greatest(hwm - at_offset, 0) AS lag, in_sync FROM r WHERE node_id <> leader_id")
def replication_lag(spark, d):
    marks, a = _assignments(spark, d)
    return C.replication_lag(a, marks)


@query("replication_hwm", _ASSIGN + "SELECT partition_id, coalesce(min(CASE WHEN in_sync AND node_id <> leader_id THEN at_offset END), 0) AS replication_hwm FROM r GROUP BY partition_id")
def replication_hwm(spark, d):
    return C.replication_marks(_assignments(spark, d)[1])


@query("quorum_check", 'SELECT partition_id, "offset", 1 + (CASE WHEN arrival % 3 = 0 THEN 1 ELSE 0 END) + (CASE WHEN arrival % 5 = 0 THEN 1 ELSE 0 END) AS acks, 1 + (CASE WHEN arrival % 3 = 0 THEN 1 ELSE 0 END) + (CASE WHEN arrival % 5 = 0 THEN 1 ELSE 0 END) >= 2 AS committed FROM log')
def quorum_check(spark, d):
    acks = L.event_log(spark, d).select("partition_id", "offset", F.explode(F.array(F.col("arrival") % 3 == 0, F.col("arrival") % 5 == 0)).alias("ok"))
    return C.quorum(acks, ["partition_id", "offset"], 2)


@query(
    "failover_leader",
    _ASSIGN + ", k AS (SELECT *, row_number() OVER (PARTITION BY partition_id ORDER BY in_sync DESC, at_offset DESC, node_id) AS n FROM r WHERE node_id <> 'node-1' AND node_id <> leader_id) SELECT partition_id, node_id AS new_leader FROM k WHERE n = 1",
)
def failover_leader(spark, d):
    return C.failover(_assignments(spark, d)[1], _alive(spark))


@query("under_replicated", _ASSIGN + "SELECT partition_id, count(*) FILTER (in_sync AND node_id <> 'node-1') AS live_isr FROM r GROUP BY partition_id HAVING count(*) FILTER (in_sync AND node_id <> 'node-1') < 2")
def under_replicated(spark, d):
    return C.under_replicated(_assignments(spark, d)[1], _alive(spark), 2)


@query(
    "assignment_diff",
    "SELECT partition_id, CASE WHEN partition_id % 2 = 1 THEN 'node-3' ELSE '' END AS added, CASE WHEN partition_id % 2 = 1 THEN 'node-2' ELSE '' END AS removed, partition_id % 4 = 2 AS leader_moved FROM marks",
)
def assignment_diff(spark, d):
    a = _assignments(spark, d)[1].select("partition_id", "leader_id", "replicas")
    odd = F.col("partition_id") % 2 == 1
    new = a.select(
        "partition_id",
        F.when(F.col("partition_id") % 4 == 2, "node-9").otherwise(F.col("leader_id")).alias("leader_id"),
        F.when(odd, F.array(F.lit("node-0"), F.lit("node-1"), F.lit("node-3"))).otherwise(F.col("replicas")).alias("replicas"),
    )
    return C.assignment_diff(a, new)


@query("cluster_topology", "SELECT partition_id, 'node-' || (partition_id % 3) AS leader_id, CASE WHEN partition_id % 3 = 1 THEN false ELSE true END AS leader_alive, CASE WHEN partition_id % 3 = 1 THEN 'r1' ELSE 'r0' END AS rack FROM marks")
def cluster_topology(spark, d):
    return C.topology(_assignments(spark, d)[1], _nodes(spark)).select("partition_id", "leader_id", "leader_alive", "rack")


@query("cluster_stats", _ASSIGN + "SELECT count(DISTINCT node_id) AS nodes, count(DISTINCT node_id) FILTER (node_id <> 'node-1') AS alive, count(DISTINCT partition_id) AS partitions, count(DISTINCT leader_id) AS leaders FROM r")
def cluster_stats(spark, d):
    return C.cluster_stats(_assignments(spark, d)[1], _nodes(spark))


@query("member_states", "SELECT * FROM (VALUES ('node-0', 'alive', false), ('node-1', 'dead', true), ('node-2', 'suspect', false)) t(node_id, state, skewed)")
def member_states(spark, d):
    return C.member_states(_nodes(spark), NOW)


@query(
    "ring_owner",
    """, nodes AS (SELECT 'node-' || i AS node_id FROM range(5) t(i)), pts AS (SELECT node_id, substr(sha256(node_id || '#' || v), 1, 16) AS pos FROM nodes, range(50) t(v)),
    ks AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS key, substr(sha256(CAST(user_id AS VARCHAR)), 1, 16) AS h FROM ev),
    f AS (SELECT key, coalesce((SELECT min(pos) FROM pts WHERE pos >= h), (SELECT min(pos) FROM pts)) AS pos FROM ks)
    SELECT key, node_id AS owner FROM f JOIN pts USING (pos)""",
)
def ring_owner(spark, d):
    nodes = spark.range(5).select(F.concat(F.lit("node-"), F.col("id").cast("string")).alias("node_id"), F.lit("").alias("rack"))
    keys = L.from_events(spark, d).select(F.col("meta")["partition_key"].alias("key")).distinct()
    return C.owners(keys, C.ring(spark, nodes)).select("key", "owner")


_RING = """, nodes AS (SELECT 'node-' || i AS node_id, 'r' || (i % 3) AS rack FROM range(5) t(i)), pts AS (SELECT node_id, rack, substr(sha256(node_id || '#' || v), 1, 16) AS pos FROM nodes, range(50) t(v)),
    ks AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS key, substr(sha256(CAST(user_id AS VARCHAR)), 1, 16) AS h FROM ev)"""


# Three racks and five nodes: the first point of each rack from the key on is a replica.
@query(
    "ring_replicas",
    _RING
    + """, f AS (SELECT key, rack, min(CASE WHEN pos >= h THEN '0' ELSE '1' END || pos) AS turn FROM ks, pts GROUP BY key, rack)
    SELECT key, string_agg(node_id, ',' ORDER BY turn) AS replicas FROM f JOIN pts ON pts.pos = substr(turn, 2) GROUP BY key""",
)
def ring_replicas(spark, d):
    nodes = spark.range(5).select(F.concat(F.lit("node-"), F.col("id").cast("string")).alias("node_id"), F.concat(F.lit("r"), (F.col("id") % 3).cast("string")).alias("rack"))
    keys = L.from_events(spark, d).select(F.col("meta")["partition_key"].alias("key")).distinct()
    return C.replicas(keys, C.ring(spark, nodes), 3).select("key", F.array_join("replicas", ",").alias("replicas"))


@query(
    "ring_distribution",
    _RING
    + """, f AS (SELECT key, min(CASE WHEN pos >= h THEN '0' ELSE '1' END || pos) AS turn FROM ks, pts GROUP BY key)
    SELECT node_id AS owner, count(*) AS keys FROM f JOIN pts ON pts.pos = substr(turn, 2) GROUP BY node_id""",
)
def ring_distribution(spark, d):
    return ring_owner(spark, d).groupBy("owner").agg(F.count("*").alias("keys"))
