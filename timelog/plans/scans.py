"""Scans, seeks, scheduling and scalar functions."""

import uuid

from pyspark.sql import functions as F

from timelog.functions import scalars as X
from timelog.operators import lifecycle, schedule
from timelog.plans.registry import CRC_TABLE, NOW, bytes_sql, crc_sql, query
from timelog.shared import shared_dir
from timelog.sources import files
from timelog.sources import log as L
from timelog.sources import wal

DAY = 86_400_000
_FNV_BYTES = "list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(data, lambda b: b::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"


@query("route_partitions", "SELECT partition_id, count(*) AS n, count(DISTINCT user_id) AS keys FROM routed GROUP BY partition_id")
def route_partitions(spark, d):
    return L.from_events(spark, d).groupBy("partition_id").agg(F.count("*").alias("n"), F.count_distinct(F.col("meta")["partition_key"]).alias("keys"))


@query("assign_offsets", 'SELECT message_id, partition_id, "offset", schedule_ts FROM log')
def assign_offsets(spark, d):
    return L.assign_offsets(L.from_events(spark, d)).select("message_id", "partition_id", "offset", "schedule_ts")


@query(
    "second_log_offsets",
    """, o AS (SELECT o_orderkey, epoch_us(o_orderdate) // 1000 AS schedule_ts, CAST(o_custkey AS VARCHAR) AS k FROM orders),
    u AS (SELECT DISTINCT k FROM o), r AS (SELECT k, CAST(list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split(k, ''), lambda x: ascii(x)::UHUGEINT)), lambda h, c: (xor(h, c) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) % 8 AS INTEGER) AS partition_id FROM u)
    SELECT o_orderkey AS arrival, partition_id, row_number() OVER (PARTITION BY partition_id ORDER BY o_orderkey) - 1 AS "offset", schedule_ts FROM o JOIN r USING (k)""",
)
def second_log_offsets(spark, d):
    return L.assign_offsets(L.from_orders(spark, d)).select("arrival", "partition_id", "offset", "schedule_ts")


@query(
    "replay_time_range",
    f'SELECT message_id, "offset", schedule_ts, row_number() OVER (ORDER BY "offset") - 1 AS seq FROM log WHERE partition_id = 3 AND schedule_ts BETWEEN {NOW - 3 * DAY} AND {NOW}',
)
def replay_time_range(spark, d):
    return L.replay_times(L.event_log(spark, d), 3, NOW - 3 * DAY, None, NOW).select("message_id", "offset", "schedule_ts", "seq")


@query("replay_offset_range", 'SELECT message_id, partition_id, "offset" FROM log WHERE "offset" BETWEEN 50 AND 149')
def replay_offset_range(spark, d):
    return L.offset_range(L.event_log(spark, d), 50, 149).select("message_id", "partition_id", "offset")


@query("replay_default_limit", 'SELECT message_id, "offset" FROM log WHERE partition_id = 2 AND "offset" BETWEEN 10 AND 1009')
def replay_default_limit(spark, d):
    return L.replay_offsets(L.event_log(spark, d), 2, 10).select("message_id", "offset")


@query("point_lookup", 'SELECT message_id, topic, schedule_ts FROM log WHERE partition_id = 1 AND "offset" = 17')
def point_lookup(spark, d):
    return L.point(L.event_log(spark, d), 1, 17).select("message_id", "topic", "schedule_ts")


@query(
    "seek_positions",
    f"""SELECT partition_id, min("offset") AS earliest, max("offset") + 1 AS latest,
    coalesce(min(CASE WHEN schedule_ts BETWEEN {NOW - DAY} AND {NOW} THEN "offset" END), max("offset") + 1) AS at_time FROM log GROUP BY partition_id""",
)
def seek_positions(spark, d):
    return L.seek(L.event_log(spark, d), NOW - DAY, NOW)


@query("cold_range_scan", f'SELECT partition_id, schedule_ts, "offset" FROM log WHERE schedule_ts BETWEEN {NOW + 3600000} AND {NOW + DAY}')
def cold_range_scan(spark, d):
    return L.cold_scan(L.event_log(spark, d), NOW + 3600000, NOW + DAY)


@query(
    "maturity_split",
    f"""SELECT partition_id, CASE WHEN schedule_ts <= {NOW} THEN 'due' WHEN schedule_ts <= {NOW + 3600000} THEN 'hot' ELSE 'cold' END AS tier,
    count(*) AS n, min(schedule_ts) AS first_ts FROM log GROUP BY 1, 2""",
)
def maturity_split(spark, d):
    return schedule.tier_counts(L.event_log(spark, d), NOW)


@query("hydrate_window", f'SELECT message_id, partition_id, "offset", schedule_ts FROM log WHERE schedule_ts BETWEEN {NOW + 3600000} AND {NOW + 3600000 + 7200000}')
def hydrate_window(spark, d):
    log = L.event_log(spark, d)
    cold = schedule.maturity(log, NOW).where("tier = 'cold'").select("partition_id", "offset", "schedule_ts")
    return schedule.hydrate(cold, log, NOW, lookahead_ms=7_200_000).select("message_id", "partition_id", "offset", "schedule_ts")


@query(
    "scheduler_status",
    f"""SELECT partition_id, count(*) FILTER (schedule_ts > {NOW}) AS active, count(*) FILTER (schedule_ts <= {NOW}) AS ready,
    max(CASE WHEN schedule_ts > {NOW} THEN schedule_ts - {NOW} END) AS max_delay_ms,
    CAST(floor(sum(CASE WHEN schedule_ts > {NOW} THEN schedule_ts - {NOW} END) / count(CASE WHEN schedule_ts > {NOW} THEN 1 END)) AS BIGINT) AS avg_delay_ms FROM log GROUP BY partition_id""",
)
def scheduler_status(spark, d):
    return schedule.status(L.event_log(spark, d), NOW)


@query(
    "recovered_timers",
    f"""SELECT message_id, partition_id, "offset", CASE WHEN schedule_ts <= {NOW} THEN 'ready' ELSE 'timer' END AS route FROM log WHERE "offset" > CASE WHEN partition_id % 2 = 0 THEN partition_id * 20 ELSE -1 END""",
)
def recovered_timers(spark, d):
    """Even partitions have a checkpoint file, odd ones replay from the start."""
    log = L.event_log(spark, d)
    path = f"{shared_dir(spark)}/timers-{uuid.uuid4().hex}"
    files.write_checkpoints(log.where("partition_id % 2 = 0").select("partition_id").distinct().select("partition_id", (F.col("partition_id") * 20).cast("long").alias("last_scheduled")), path)
    return schedule.recovered(log, files.read_checkpoints(spark, path), NOW).select("message_id", "partition_id", "offset", "route")


@query(
    "partition_health",
    f"""SELECT partition_id, max("offset") AS high_watermark, count(DISTINCT "offset" // 100) AS segments, count(*) FILTER (schedule_ts > {NOW} AND schedule_ts <= {NOW + 3600000}) AS active_timers,
    count(*) FILTER (schedule_ts <= {NOW}) AS ready_events, count(*) FILTER (schedule_ts > {NOW + 3600000}) AS cold_entries, partition_id = 3 AS replay_error, CASE WHEN partition_id = 3 THEN 'bad record' END AS last_error FROM log GROUP BY partition_id""",
)
def partition_health(spark, d):
    log = L.event_log(spark, d)
    return schedule.health(log, lifecycle.segments(log), NOW, errors=spark.createDataFrame([(3, "bad record")], "partition_id int, error string"))


@query("snapshot_files", 'SELECT partition_id, max("offset") AS last_offset FROM log GROUP BY partition_id HAVING max("offset") >= 100')
def snapshot_files(spark, d):
    """What a replica at offset 100 has to copy: the files end where the log ends, and none ends below 100."""
    found = files.segment_files(L.event_log(spark, d), 100)
    return found.groupBy("partition_id").agg(F.max("last_offset").alias("last_offset"), F.min("last_offset").alias("least")).where("least >= 100").drop("least")


@query(
    "row_functions",
    f"""SELECT message_id, CASE WHEN event_id % 3 = 0 THEN {NOW} ELSE schedule_ts END AS resolved, substr(repeat(topic, 100), 1, 256) AS label, CASE WHEN event_id % 4 = 0 THEN event_id END AS file_offset,
    event_id % 4 IN (0, 1) AS supported, lpad(format('{{:x}}', {_FNV_BYTES}), 16, '0') AS schema_hash FROM (SELECT *, {bytes_sql("topic || props")} AS data FROM ev)""",
)
def row_functions(spark, d):
    """Scalar functions over every event: schedule times, labels, offsets in file names, client versions, schema hashes."""
    rows = L.from_events(spark, d)
    n = F.col("arrival")
    name = F.when(n % 4 == 0, F.concat(F.lit("seg-"), F.hex(n), F.lit(".log"))).otherwise("readme")
    return rows.select(
        "message_id",
        X.resolve_schedule(F.when(n % 3 == 0, 0).otherwise(F.col("schedule_ts")), F.timestamp_millis(F.lit(NOW))).alias("resolved"),
        X.metric_label(F.repeat("topic", F.lit(100))).alias("label"),
        X.offset_of_file(name).alias("file_offset"),
        X.client_supported(F.when(n % 4 == 1, 1).when(n % 4 > 1, n % 4)).alias("supported"),
        X.schema_hash(F.col("topic"), F.col("payload")).alias("schema_hash"),
    )


@query(
    "wheel_slots",
    f""", t AS (SELECT *, schedule_ts - {NOW} AS delay FROM log WHERE schedule_ts > {NOW}),
    v AS (SELECT *, CASE WHEN delay // 10 < 512 THEN 0 WHEN delay // 5120 < 512 THEN 1 WHEN delay // 2621440 < 512 THEN 2 WHEN delay // 1342177280 < 512 THEN 3 ELSE 4 END AS level FROM t)
    SELECT message_id, level, CAST((delay // CAST(10 * power(512, level) AS BIGINT)) % 512 AS INTEGER) AS slot FROM v""",
)
def wheel_slots(spark, d):
    return schedule.wheel(L.event_log(spark, d), NOW).select("message_id", "level", "slot")


@query("delivery_batches", 'SELECT partition_id, "offset" // 100 AS batch_id, count(*) AS n FROM log GROUP BY 1, 2')
def delivery_batches(spark, d):
    return schedule.batches(L.event_log(spark, d)).groupBy("partition_id", "batch_id").agg(F.count("*").alias("n"))


@query(
    "sync_page",
    """, t AS (SELECT message_id, "offset", sum(strlen(props)) OVER (ORDER BY "offset") AS upto FROM log WHERE partition_id = 4 AND "offset" >= 20)
    SELECT message_id, "offset", CAST(upto AS BIGINT) AS upto FROM t WHERE upto <= 2000 OR "offset" = 20""",
)
def sync_page(spark, d):
    return L.sync_page(L.event_log(spark, d), 4, 20, 2000).select("message_id", "offset", "upto")


@query(
    "fetch_pages",
    """, t AS (SELECT ("offset" - 20) // 101 AS batch, strlen(props) AS size FROM log WHERE partition_id = 4 AND "offset" >= 20),
    b AS (SELECT batch, count(*) AS n, sum(size) AS bytes, sum(sum(size)) OVER (ORDER BY batch) AS upto FROM t GROUP BY batch)
    SELECT batch, n, CAST(bytes AS BIGINT) AS bytes, upto < 5000 AND n = 101 AS has_more FROM b WHERE upto - bytes < 5000""",
)
def fetch_pages(spark, d):
    found = L.fetch(L.event_log(spark, d), 4, 20, 5000)
    return found.groupBy("batch", "has_more").agg(F.count("*").alias("n"), F.sum(F.length("payload")).cast("long").alias("bytes"))


@query("checksums", f"{CRC_TABLE} SELECT message_id, {crc_sql(bytes_sql('props'))} AS checksum, sha1(props) AS sha1 FROM log, crc")
def checksums(spark, d):
    return L.event_log(spark, d).select("message_id", X.checksum(F.col("payload")).alias("checksum"), X.sha1_hex(F.col("payload")).alias("sha1"))


def _big_endian(value: str, size: int) -> str:
    return f"list_transform(range({size}), lambda k: ({value} >> (8 * ({size - 1} - k))) % 256)"


@query(
    "batch_checksums",
    f"""{CRC_TABLE}, p AS (SELECT partition_id, "offset" // 100 AS batch_id, "offset" AS o, arrival % 7 AS term, {bytes_sql("props")} AS data FROM log),
    q AS (SELECT *, {crc_sql("data")} AS c FROM p, crc),
    b AS (SELECT partition_id, batch_id, t, flatten(list(list_concat({_big_endian("o", 8)}, {_big_endian("term", 8)}, {_big_endian("c", 4)}, data) ORDER BY o)) AS xs FROM q GROUP BY ALL)
    SELECT partition_id, batch_id, {crc_sql("xs")} AS checksum FROM b""",
)
def batch_checksums(spark, d):
    log = schedule.batches(L.event_log(spark, d)).withColumns({"term": F.col("arrival") % 7, "checksum": F.lit(0)})
    rows = log.groupBy("partition_id", "batch_id").agg(F.array_sort(F.collect_list(F.struct("offset", "term", "checksum", "payload"))).alias("rows"))
    return rows.select("partition_id", "batch_id", X.batch_checksum(F.col("rows")).alias("checksum"))


@query("sha1_digests", "SELECT message_id, sha1(props) AS sha1 FROM ev")
def sha1_digests(spark, d):
    return L.from_events(spark, d).select("message_id", X.sha1_hex(F.col("payload")).alias("sha1"))


@query(
    "backoff_table",
    "SELECT CAST(i AS INTEGER) AS attempt, i * 1000 AS delivery_ms, CAST(least(100 * power(2, i), 10000) AS BIGINT) AS client_ms, CAST(least(power(2, i), 300) AS BIGINT) AS recovery_s FROM range(20) t(i)",
)
def backoff_table(spark, d):
    t = spark.range(20).select(F.col("id").cast("int").alias("attempt"))
    a = F.col("attempt")
    return t.select("attempt", X.delivery_backoff(a).alias("delivery_ms"), X.client_backoff(a).alias("client_ms"), X.recovery_backoff(a).alias("recovery_s"))


@query(
    "created_units",
    "SELECT message_id, CASE WHEN event_id % 2 = 0 THEN schedule_ts * 1000000 ELSE CASE WHEN schedule_ts > 10000000000000000 THEN schedule_ts ELSE schedule_ts * 1000000 END END AS created_ns FROM ev",
)
def created_units(spark, d):
    mixed = F.when(F.col("arrival") % 2 == 0, F.col("schedule_ts") * 1_000_000).otherwise(F.col("schedule_ts"))
    return L.from_events(spark, d).select("message_id", X.created_nanos(mixed).alias("created_ns"))


@query(
    "adaptive_intervals",
    """, t AS (SELECT partition_id, count(*) AS n, max("offset") AS m FROM log GROUP BY partition_id),
    a AS (SELECT partition_id, n, m, CAST(floor(10000 * CASE WHEN n > 10000 THEN 0.4 WHEN n > 5000 THEN 0.5 WHEN n > 1000 THEN 0.6 WHEN n > 100 THEN 0.8 WHEN n = 0 THEN 1.5 ELSE 1.1 END) AS BIGINT) AS s FROM t),
    b AS (SELECT *, CASE WHEN m > s // 2 THEN CAST(floor(s * 0.7) AS BIGINT) ELSE s END AS s2 FROM a)
    SELECT partition_id, greatest(1000, least(60000, CASE WHEN n > 1000 THEN CAST(floor(s2 * 0.5) AS BIGINT) ELSE s2 END)) AS interval_ms FROM b""",
)
def adaptive_intervals(spark, d):
    t = L.event_log(spark, d).groupBy("partition_id").agg(F.count("*").alias("n"), F.max("offset").alias("m"))
    return t.select("partition_id", X.adapted_interval(F.lit(10_000), F.col("n"), F.col("m"), F.col("n")).alias("interval_ms"))


@query("wal_round_trip", 'SELECT partition_id, "offset", schedule_ts, message_id, topic, props AS payload, CAST(user_id AS VARCHAR) AS partition_key FROM log')
def wal_round_trip(spark, d):
    rows = wal.decoded(wal.encoded(L.event_log(spark, d)))
    return rows.where("valid").select("partition_id", "offset", "schedule_ts", "message_id", "topic", F.decode("payload", "UTF-8").alias("payload"), F.col("meta")["partition_key"].alias("partition_key"))


@query("sealed_round_trip", 'SELECT partition_id, "offset", message_id FROM log')
def sealed_round_trip(spark, d):
    key = b"0123456789abcdef0123456789abcdef"
    rows = wal.decoded(wal.opened(wal.sealed(wal.encoded(L.event_log(spark, d)), key), key))
    return rows.select("partition_id", "offset", "message_id")


@query(
    "auto_ids",
    f""", p AS (SELECT message_id, list_concat({bytes_sql("topic")}, [0], {bytes_sql("CAST(user_id AS VARCHAR)")}, [0], {bytes_sql("CAST(schedule_ts AS VARCHAR)")}, [0], {bytes_sql("props")}) AS data FROM ev)
    SELECT message_id, 'auto-' || lpad(format('{{:x}}', {_FNV_BYTES}), 16, '0') AS auto_id,
      CAST(list_reduce(list_prepend(0, {bytes_sql("message_id")}), lambda h, b: (h * 31 + b) % 4294967296) % 32 AS INTEGER) AS shard FROM p""",
)
def auto_ids(spark, d):
    log = L.from_events(spark, d)
    key = X.partition_key(F.col("meta"), F.col("message_id"))
    return log.select("message_id", X.auto_message_id(F.col("topic"), key, F.col("schedule_ts"), F.col("payload")).alias("auto_id"), X.shard_of(F.col("message_id")).alias("shard"))
