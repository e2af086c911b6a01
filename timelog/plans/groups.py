"""Consumer groups, watermarks and lag."""

import uuid

from pyspark.sql import functions as F

from timelog.operators import groups as G
from timelog.operators import publish
from timelog.plans.registry import query
from timelog.shared import shared_dir
from timelog.sources import log as L


def marks(spark, d):
    return G.high_watermarks(L.event_log(spark, d))


def commits(found, n: int = 3):
    """Groups g0..g2 on every partition, each further on than the one before."""
    i = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return found.select("partition_id", "hwm", i.alias("i")).select(
        F.concat(F.lit("g"), F.col("i").cast("string")).alias("group_id"), "partition_id", F.floor(F.col("hwm") * (F.col("i") + 1) / 4).cast("long").alias("committed")
    )


def _groups(spark, d):
    return commits(marks(spark, d)).groupBy("group_id").agg(F.collect_list("partition_id").alias("partitions"))


def _members(spark, d):
    n = F.explode(F.sequence(F.lit(0), F.col("group_id").substr(2, 1).cast("int"))).alias("n")
    return _groups(spark, d).select("group_id", n).select("group_id", F.concat(F.lit("m"), F.col("n").cast("string")).alias("member_id"))


@query("high_watermarks", "SELECT partition_id, hwm, hwm AS last_offset, next_offset FROM marks")
def high_watermarks(spark, d):
    return marks(spark, d)


@query("consumer_lag", "SELECT group_id, partition_id, committed, hwm, greatest(hwm - committed, 0) AS lag, greatest(next_offset - committed, 0) AS backlog FROM groups JOIN marks USING (partition_id)")
def consumer_lag(spark, d):
    found = marks(spark, d)
    return G.lag(commits(found), found)


@query("lag_alerts", "SELECT group_id, partition_id, round((hwm - committed) / hwm, 6) AS share FROM groups JOIN marks USING (partition_id) WHERE (hwm - committed) / hwm > 0.4")
def lag_alerts(spark, d):
    found = marks(spark, d)
    share = F.col("lag") / F.col("hwm")
    return G.lag(commits(found), found).where(share > 0.4).select("group_id", "partition_id", F.round(share, 6).alias("share"))


@query("min_consumed", "SELECT partition_id, least(min(hwm), min(committed)) AS min_consumed FROM groups JOIN marks USING (partition_id) GROUP BY partition_id")
def min_consumed(spark, d):
    found = marks(spark, d)
    return G.min_consumed(commits(found), found)


@query(
    "committed_offsets",
    "SELECT group_id, partition_id, CASE WHEN group_id = 'g1' THEN committed + 5 WHEN group_id = 'g2' THEN -1 ELSE committed END AS committed FROM groups",
)
def committed_offsets(spark, d):
    all_ = commits(marks(spark, d))
    pending = all_.where("group_id = 'g1'").select("group_id", "partition_id", (F.col("committed") + 5).alias("committed"), F.lit(1).alias("seq"))
    return G.committed_offsets(all_.where("group_id <> 'g2'"), pending, all_)


@query("group_metadata", "SELECT group_id, CAST(count(*) AS INTEGER) AS n_partitions, CAST(sum(committed) FILTER (i > 0) AS BIGINT) AS committed, CAST(CASE WHEN min(i) = 0 THEN 0 ELSE count(*) END AS INTEGER) AS n_offsets FROM groups GROUP BY group_id")
def group_metadata(spark, d):
    """Groups written and loaded again; g0 has no committed offsets."""
    all_ = commits(marks(spark, d))
    entries = F.array_sort(F.collect_list(F.struct(F.col("partition_id").cast("string").alias("k"), F.col("committed").alias("v"))))
    rows = all_.groupBy("group_id").agg(F.array_sort(F.collect_list("partition_id")).alias("partitions"), F.map_from_entries(entries).alias("all"))
    path = f"{shared_dir(spark)}/groups-{uuid.uuid4().hex}"
    G.write_groups(rows.select("group_id", F.lit("t").alias("topic"), "partitions", F.when(F.col("group_id") != "g0", F.col("all")).alias("committed_offsets")), path)
    offsets = F.map_values("committed_offsets")
    total = F.aggregate(offsets, F.lit(0).cast("long"), lambda a, x: a + x)
    return G.read_groups(spark, path).select("group_id", F.size("partitions").alias("n_partitions"), F.when(F.size(offsets) > 0, total).alias("committed"), F.size(offsets).alias("n_offsets"))


@query("running_checkpoint", ', s AS (SELECT topic AS consumer, arrival AS seq, "offset" * 7919 % 1000003 AS "offset" FROM log) SELECT consumer, seq, max("offset") OVER (PARTITION BY consumer ORDER BY seq) AS checkpoint FROM s')
def running_checkpoint(spark, d):
    saves = L.event_log(spark, d).select(F.col("topic").alias("consumer"), F.col("arrival").alias("seq"), (F.col("offset") * 7919 % 1000003).alias("offset"))
    return publish.running_checkpoint(saves).select("consumer", "seq", "checkpoint")


@query("remembered_commits", "SELECT user_id || ':' || (event_id % 7) AS commit_id, min(event_id) AS seq FROM ev GROUP BY 1 ORDER BY seq DESC LIMIT 200")
def remembered_commits(spark, d):
    """The commit ids that a bounded memory of 200 still knows."""
    rows = L.from_events(spark, d).select(F.concat_ws(":", F.col("meta")["partition_key"], (F.col("arrival") % 7).cast("string")).alias("commit_id"), F.col("arrival").alias("seq"))
    return publish.newest_n(publish.once_per_commit(rows), "seq", 200)


@query("offset_upserts", "SELECT topic AS group_id, partition_id, arg_max(\"offset\", arrival) AS committed FROM log GROUP BY 1, 2")
def offset_upserts(spark, d):
    return G.upsert_offsets(L.event_log(spark, d).select(F.col("topic").alias("group_id"), "partition_id", F.col("offset").alias("committed"), F.col("arrival").alias("seq")))


@query(
    "group_rebalance",
    "SELECT group_id, partition_id, 'm' || ((row_number() OVER (PARTITION BY group_id ORDER BY partition_id) - 1) % (i + 1)) AS member_id FROM groups",
)
def group_rebalance(spark, d):
    return G.rebalance(_groups(spark, d), _members(spark, d))


@query("group_stats", "SELECT count(DISTINCT group_id) AS groups, count(DISTINCT group_id) AS active_groups, CAST(sum(DISTINCT i + 1) AS BIGINT) AS members FROM groups")
def group_stats(spark, d):
    return G.group_stats(_groups(spark, d), _members(spark, d))


@query("group_listing", "SELECT DISTINCT topic, 'g' || (user_id % 4) AS group_id FROM ev")
def group_listing(spark, d):
    rows = L.from_events(spark, d).select("topic", F.concat(F.lit("g"), (F.col("meta")["partition_key"].cast("long") % 4).cast("string")).alias("group_id"))
    return G.listing(rows)
