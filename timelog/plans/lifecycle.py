"""Segments, retention, compaction, splits and transactions."""

import uuid

from pyspark.sql import functions as F

from timelog.operators import folds, groups, transactions
from timelog.operators import lifecycle as O
from timelog.plans.groups import commits
from timelog.plans.registry import NOW, query
from timelog.shared import shared_dir
from timelog.sources import files
from timelog.sources import log as L

DAY = 86_400_000
_ACTIVE = ", act AS (SELECT *, first_offset = max(first_offset) OVER (PARTITION BY partition_id) AS active FROM segs) "


def _segs(spark, d):
    return O.segments(L.event_log(spark, d))


@query("segment_table", "SELECT partition_id, segment_id, first_offset, last_offset, created_ts, newest_ts, size, events FROM segs")
def segment_table(spark, d):
    return _segs(spark, d).withColumn("size", F.col("size").cast("long")).drop("last_ts")


@query("segment_usage", "SELECT partition_id, count(*) AS segments, CAST(sum(size) AS BIGINT) AS bytes FROM segs GROUP BY partition_id")
def segment_usage(spark, d):
    return O.usage(_segs(spark, d))


@query("active_segments", _ACTIVE + "SELECT partition_id, segment_id, first_offset FROM act WHERE active")
def active_segments(spark, d):
    return O.active(_segs(spark, d)).where("active").select("partition_id", "segment_id", "first_offset")


@query(
    "wal_status",
    "SELECT partition_id, min(first_offset) AS first_offset, max(last_offset) AS last_offset, arg_min(created_ts, first_offset) AS oldest_ts, arg_max(newest_ts, first_offset) AS newest_ts, count(*) AS segments, CAST(sum(size) AS BIGINT) AS bytes FROM segs GROUP BY partition_id",
)
def wal_status(spark, d):
    return O.wal_status(_segs(spark, d))


@query(
    "partition_info",
    "SELECT l.partition_id, count(*) AS events, count(DISTINCT topic) AS topics, min(hwm) AS hwm, min(g.n) AS n_groups FROM log l JOIN marks USING (partition_id) JOIN (SELECT partition_id, count(*) AS n FROM groups GROUP BY 1) g ON g.partition_id = l.partition_id GROUP BY l.partition_id",
)
def partition_info(spark, d):
    log = L.event_log(spark, d)
    info = log.groupBy("partition_id").agg(F.count("*").alias("events"), F.count_distinct("topic").alias("topics"), F.max("offset").alias("hwm"))
    n = commits(info).groupBy("partition_id").agg(F.count("*").alias("n_groups"))
    return info.join(n, "partition_id")


@query("retention_age", _ACTIVE + f"SELECT partition_id, segment_id FROM act WHERE NOT active AND created_ts < {NOW - 10 * DAY}")
def retention_age(spark, d):
    return O.expired_by_age(_segs(spark, d), NOW, 10 * DAY).select("partition_id", "segment_id")


@query(
    "retention_size",
    _ACTIVE
    + """, tot AS (SELECT sum(size) AS total FROM segs), o AS (SELECT *, coalesce(sum(size) OVER (ORDER BY created_ts, first_offset, partition_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM act WHERE NOT active)
    SELECT partition_id, segment_id FROM o, tot WHERE total - before > 50000""",
)
def retention_size(spark, d):
    return O.expired_by_size(_segs(spark, d), 50_000).select("partition_id", "segment_id")


@query(
    "compaction_plan",
    _ACTIVE
    + """, c AS (SELECT partition_id, least(min(hwm), min(committed)) AS m FROM groups JOIN marks USING (partition_id) GROUP BY partition_id)
    SELECT partition_id, segment_id, last_offset FROM act JOIN c USING (partition_id) WHERE NOT active AND last_offset > 0 AND last_offset < m""",
)
def compaction_plan(spark, d):
    log = L.event_log(spark, d)
    marks = groups.high_watermarks(log)
    return O.compactable(O.segments(log), groups.min_consumed(commits(marks), marks)).select("partition_id", "segment_id", "last_offset")


@query("backup_restored", _ACTIVE + ', b AS (SELECT partition_id, segment_id FROM act WHERE NOT active AND last_offset > 250) SELECT message_id, log.partition_id, "offset" FROM log JOIN b ON log.partition_id = b.partition_id AND "offset" // 100 = segment_id')
def backup_restored(spark, d):
    """Two backups that overlap, and the log that they give back."""
    log = L.event_log(spark, d)
    path = f"{shared_dir(spark)}/backup-{uuid.uuid4().hex}"
    for checkpoint in (450, 250):
        files.backup(log, O.backup_set(O.segments(log), checkpoint), path)
    files.restore(spark, path, f"{path}-restored", log.schema)
    return files.read_log(spark, f"{path}-restored", log.schema).select("message_id", "partition_id", "offset")


@query("compacted_by_offset", _ACTIVE + "SELECT partition_id, segment_id FROM act WHERE NOT active AND last_offset > 0 AND last_offset < 500")
def compacted_by_offset(spark, d):
    return O.compacted_by_offset(_segs(spark, d), 500).select("partition_id", "segment_id")


@query(
    "compacted_by_time",
    _ACTIVE + f', l AS (SELECT partition_id, "offset" // 100 AS segment_id, arg_max(schedule_ts, "offset") AS last_ts FROM log GROUP BY 1, 2) SELECT partition_id, segment_id FROM act JOIN l USING (partition_id, segment_id) WHERE NOT active AND last_ts < {NOW} AND last_ts > 0',
)
def compacted_by_time(spark, d):
    return O.compacted_by_time(_segs(spark, d), NOW).select("partition_id", "segment_id")


@query(
    "log_after_compaction",
    _ACTIVE
    + """, c AS (SELECT partition_id, min(committed) AS m, min(hwm) AS h FROM groups JOIN marks USING (partition_id) GROUP BY partition_id),
    gone AS (SELECT partition_id, segment_id FROM act JOIN c USING (partition_id) WHERE NOT active AND m > 0 AND m < h AND last_offset > 0 AND last_offset < m)
    SELECT message_id, partition_id, "offset" FROM log WHERE (partition_id, "offset" // 100) NOT IN (SELECT (partition_id, segment_id) FROM gone)""",
)
def log_after_compaction(spark, d):
    """What is left of the log once a compaction job has removed what all consumers are past."""
    log = L.event_log(spark, d)
    marks = groups.high_watermarks(log)
    gone = O.compacted_by_consumers(O.segments(log), commits(marks), marks)
    return O.without_segments(log, gone).select("message_id", "partition_id", "offset")


@query("backup_set", _ACTIVE + "SELECT partition_id, segment_id FROM act WHERE NOT active AND last_offset > 400")
def backup_set(spark, d):
    return O.backup_set(_segs(spark, d), 400).select("partition_id", "segment_id")


@query(
    "split_partition",
    'SELECT message_id, "offset" AS source_offset, row_number() OVER (ORDER BY "offset") - 1 AS "offset", 8 AS partition_id FROM log WHERE partition_id = 5 AND "offset" >= 10 AND CAST(user_id AS VARCHAR) >= \'3\'',
)
def split_partition(spark, d):
    return O.split(L.event_log(spark, d), 5, 10, "3", 8).select("message_id", "source_offset", "offset", "partition_id")


@query(
    "corrupt_tail_prefix",
    ', b AS (SELECT partition_id, min("offset") AS bad FROM log WHERE latency_us % 997 = 0 GROUP BY 1) SELECT l.partition_id, count(*) AS n, max("offset") AS last_offset FROM log l LEFT JOIN b USING (partition_id) WHERE bad IS NULL OR "offset" < bad GROUP BY 1',
)
def corrupt_tail_prefix(spark, d):
    return O.valid_prefix(L.event_log(spark, d), F.col("latency_us") % 997 == 0).groupBy("partition_id").agg(F.count("*").alias("n"), F.max("offset").alias("last_offset"))


@query("truncated_log", 'SELECT partition_id, count(*) AS n FROM log WHERE partition_id <> 3 OR "offset" < 100 GROUP BY 1')
def truncated_log(spark, d):
    return O.truncated(L.event_log(spark, d), 3, 100).groupBy("partition_id").agg(F.count("*").alias("n"))


@query(
    "offset_gaps",
    'SELECT partition_id, min("offset") AS first_offset, max("offset") AS last_offset, max("offset") - min("offset") + 1 - count(*) AS missing FROM log WHERE arrival % 10 <> 0 GROUP BY 1',
)
def offset_gaps(spark, d):
    return O.gaps(L.event_log(spark, d).where("arrival % 10 <> 0"))


@query(
    "segment_rotation",
    """, t AS (SELECT partition_id, "offset", strlen(props) AS size, row_number() OVER (PARTITION BY partition_id ORDER BY "offset") AS k FROM log),
    b AS (
      SELECT partition_id, k, size, CAST(0 AS BIGINT) AS segment_id, size AS upto FROM t WHERE k = 1
      UNION ALL
      SELECT t.partition_id, t.k, t.size, b.segment_id + CASE WHEN b.upto >= 4096 THEN 1 ELSE 0 END, CASE WHEN b.upto >= 4096 THEN 0 ELSE b.upto END + t.size FROM b JOIN t ON t.partition_id = b.partition_id AND t.k = b.k + 1
    ) SELECT partition_id, segment_id, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM b GROUP BY 1, 2""",
)
def segment_rotation(spark, d):
    rows = L.event_log(spark, d).select("partition_id", "offset", F.length("payload").cast("long").alias("size"))
    return folds.segment_rotation(rows, 4096).groupBy("partition_id", "segment_id").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def _markers(spark, d):
    """A transaction per user: its events are markers in order, some of them ends."""
    n = F.col("arrival") % 11
    action = F.when(n < 6, "begin").when(n < 8, "prepare").when(n == 8, "committing").when(n == 9, "commit").otherwise("abort")
    return L.from_events(spark, d).select(F.concat_ws("-", F.col("meta")["partition_key"], "topic").alias("tx_id"), action.alias("action"), F.col("arrival").alias("seq"), F.col("schedule_ts").alias("ts"))


_TX = """, m AS (SELECT user_id || '-' || topic AS tx_id, arrival, schedule_ts AS ts, CASE WHEN arrival % 11 < 6 THEN 'pending' WHEN arrival % 11 < 8 THEN 'prepared' WHEN arrival % 11 = 8 THEN 'committing' WHEN arrival % 11 = 9 THEN 'committed' ELSE 'aborted' END AS status FROM ev),
  x AS (SELECT tx_id, arg_max(status, arrival) AS status, min(ts) AS created_ts, max(ts) AS updated_ts, count(*) AS markers FROM m GROUP BY tx_id) """


@query("tx_state", _TX + "SELECT tx_id, status, created_ts, updated_ts, markers FROM x")
def tx_state(spark, d):
    return transactions.states(_markers(spark, d))


@query("tx_recovery", _TX + f"SELECT tx_id, status, CASE WHEN status = 'pending' AND {NOW} - created_ts > {10 * DAY} THEN 'abort' WHEN status IN ('prepared', 'committing') THEN 'commit' ELSE 'none' END AS recovery FROM x")
def tx_recovery(spark, d):
    return transactions.recovery(transactions.states(_markers(spark, d)), NOW, 10 * DAY).select("tx_id", "status", "recovery")
