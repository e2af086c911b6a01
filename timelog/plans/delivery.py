"""Fan-out, delivery ids, dead letters, retries, feeds."""

import uuid

from pyspark.sql import functions as F

from timelog.functions import scalars as X
from timelog.operators import delivery, folds
from timelog.plans.registry import NOW, query
from timelog.shared import shared_dir
from timelog.sources import log as L



def _subscriptions(log):
    """Group g(i) has i + 1 members on every partition."""
    g = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i")
    rows = log.select("partition_id").distinct().select("partition_id", g)
    rows = rows.select("partition_id", "i", F.explode(F.sequence(F.lit(0), F.col("i"))).alias("m"))
    return rows.select(F.concat(F.lit("g"), F.col("i").cast("string")).alias("group_id"), "partition_id", F.concat(F.lit("m"), F.col("m").cast("string")).alias("member_id"))


@query(
    "fanout_round_robin",
    """SELECT message_id, 'g' || i AS group_id, 'm' || ("offset" % (i + 1)) AS member_id, 'g' || i || ':' || partition_id || ':m' || ("offset" % (i + 1)) || '-' || "offset" AS delivery_id FROM log, range(3) t(i)""",
)
def fanout_round_robin(spark, d):
    log = L.event_log(spark, d)
    return delivery.fan_out(log, _subscriptions(log)).select("message_id", "group_id", "member_id", "delivery_id")


@query(
    "delivery_ids",
    """, b AS (SELECT partition_id, "offset" // 100 AS batch, min("offset") AS first, count(*) AS n FROM log GROUP BY 1, 2)
    SELECT partition_id, batch, CASE WHEN n = 1 THEN 'g0:' || partition_id || ':m0-' || first ELSE 'g0:' || partition_id || ':m0-batch-' || first || '-' || n END AS delivery_id FROM b""",
)
def delivery_ids(spark, d):
    b = L.event_log(spark, d).groupBy("partition_id", F.floor(F.col("offset") / 100).alias("batch")).agg(F.min("offset").alias("first"), F.count("*").alias("n"))
    sub = X.subscription_id(F.lit("g0"), F.col("partition_id"), F.lit("m0"))
    return b.select("partition_id", "batch", X.delivery_id(sub, F.col("first"), F.col("n")).alias("delivery_id"))


@query("parse_delivery_ids", """SELECT 'g1:' || partition_id || ':m-' || user_id || CASE WHEN "offset" % 2 = 0 THEN '-batch-' || "offset" || '-7' ELSE '-' || "offset" END AS delivery_id, 'g1:' || partition_id || ':m-' || user_id AS subscription, 'g1' AS group_id, partition_id FROM log""")
def parse_delivery_ids(spark, d):
    log = L.event_log(spark, d)
    sub = X.subscription_id(F.lit("g1"), F.col("partition_id"), F.concat(F.lit("m-"), F.col("meta")["partition_key"]))
    ids = log.select(X.delivery_id(sub, F.col("offset"), F.when(F.col("offset") % 2 == 0, 7).otherwise(1)).alias("delivery_id"))
    group, partition = X.group_and_partition(F.col("delivery_id"))
    return ids.select("delivery_id", X.subscription_of(F.col("delivery_id")).alias("subscription"), group.alias("group_id"), partition.alias("partition_id"))


def _dead(spark, d):
    log = L.event_log(spark, d).where("topic = 'error'")
    entry = log.select("message_id", "arrival", F.concat_ws("-", F.lit("d"), F.col("arrival").cast("string")).alias("delivery_id"), F.col("schedule_ts").alias("failed_at"), (F.col("arrival") % 5 + 1).cast("int").alias("attempts"), "partition_id")
    stone = entry.where("arrival % 3 = 0").withColumn("tombstone", F.lit(True))
    return entry.withColumn("tombstone", F.lit(False)).unionByName(stone)


@query("dlq_live", "SELECT 'd-' || arrival AS delivery_id, schedule_ts AS failed_at, partition_id FROM log WHERE topic = 'error' AND arrival % 3 <> 0")
def dlq_live(spark, d):
    return delivery.live_dead_letters(_dead(spark, d)).select("delivery_id", "failed_at", "partition_id")


@query("dlq_stats", f"SELECT count(*) AS n, {NOW} - min(schedule_ts) AS oldest_ms, {NOW} - max(schedule_ts) AS newest_ms FROM log WHERE topic = 'error' AND arrival % 3 <> 0")
def dlq_stats(spark, d):
    return delivery.dead_letter_stats(delivery.live_dead_letters(_dead(spark, d)), NOW)


@query("dlq_compacted", "SELECT 'd-' || arrival AS delivery_id, 'gone' AS last_error, attempts, schedule_ts AS failed_at FROM (SELECT *, CAST(arrival % 5 + 1 AS INTEGER) AS attempts FROM log) WHERE topic = 'error' AND arrival % 3 <> 0")
def dlq_compacted(spark, d):
    """A dead-letter log in files: entries and tombstones appended, then rewritten without what is gone."""
    path = f"{shared_dir(spark)}/dead-{uuid.uuid4().hex}"
    rows = _dead(spark, d).withColumn("last_error", F.lit("gone"))
    delivery.append_dead_letters(rows.where("not tombstone"), path)
    delivery.append_tombstones(rows.where("tombstone").select("delivery_id", "failed_at"), path)
    delivery.compact_dead_letters(spark, path, f"{path}-new")
    return delivery.read_dead_letters(spark, f"{path}-new").where("not tombstone").select("delivery_id", "last_error", "attempts", "failed_at")


@query("dlq_newest", "SELECT 'd-' || arrival AS delivery_id, schedule_ts AS failed_at FROM log WHERE topic = 'error' AND arrival % 3 <> 0 ORDER BY schedule_ts DESC, arrival DESC LIMIT 50")
def dlq_newest(spark, d):
    live = delivery.live_dead_letters(_dead(spark, d))
    return live.orderBy(F.desc("failed_at"), F.desc("arrival")).limit(50).select("delivery_id", "failed_at")


@query("due_retries", f"SELECT 'd-' || arrival AS delivery_id, schedule_ts + (arrival % 5 + 1) * 1000 AS retry_at FROM log WHERE topic = 'error' AND arrival % 3 <> 0 AND schedule_ts + (arrival % 5 + 1) * 1000 <= {NOW}")
def due_retries(spark, d):
    return delivery.due_retries(delivery.live_dead_letters(_dead(spark, d)), NOW).select("delivery_id", "retry_at")


@query(
    "expired_deliveries",
    f"""SELECT message_id, CASE WHEN arrival % 6 < 5 THEN 'retry' ELSE 'dead letter' END AS action, CASE WHEN arrival % 6 < 5 THEN {NOW} + (arrival % 6) * 1000 ELSE -1 END AS retry_at FROM log WHERE schedule_ts + 30000 <= {NOW}""",
)
def expired_deliveries(spark, d):
    active = L.event_log(spark, d).select("message_id", (F.col("schedule_ts") + 30_000).alias("deadline"), (F.col("arrival") % 6).cast("int").alias("attempts"))
    return delivery.expired(active, NOW).select("message_id", "action", F.coalesce("retry_at", F.lit(-1)).alias("retry_at"))


@query(
    "dispatcher_stats",
    f""", s AS (SELECT partition_id, count(*) FILTER (schedule_ts <= {NOW} AND schedule_ts + 86400000 > {NOW}) AS used, count(*) FILTER (schedule_ts <= {NOW}) AS sent, count(*) FILTER (schedule_ts <= {NOW} AND topic = 'error') AS failed FROM log GROUP BY 1)
    SELECT count(*) AS subscriptions, CAST(sum(used) AS BIGINT) AS credits_in_use, CAST(sum(greatest(100 - used, 0)) AS BIGINT) AS credits_available, count(*) FILTER (failed >= 0.2 * sent) AS open_breakers FROM s""",
)
def dispatcher_stats(spark, d):
    """Events of the last day are in flight; a breaker is open if a fifth of a partition's deliveries so far failed."""
    due = F.col("schedule_ts") <= NOW
    s = L.event_log(spark, d).groupBy("partition_id").agg(
        F.count_if(due & (F.col("schedule_ts") + 86_400_000 > NOW)).alias("in_use"), F.count_if(due).alias("sent"), F.count_if(due & (F.col("topic") == "error")).alias("failed")
    )
    return delivery.dispatcher_stats(s.select(F.lit(100).alias("credits"), "in_use", (F.col("failed") >= F.col("sent") * 0.2).alias("breaker_open")))


@query(
    "credit_dispatch",
    """, t AS (SELECT partition_id, "offset", row_number() OVER (PARTITION BY partition_id ORDER BY "offset") AS k FROM log),
    r AS (
      SELECT partition_id, "offset", k, 0 AS pick, true AS sent, 9 AS a, 10 AS b, 10 AS c FROM t WHERE k = 1
      UNION ALL
      SELECT partition_id, "offset", k, coalesce(got, cur - 1), got IS NOT NULL, a - CASE WHEN got = 0 THEN 1 ELSE 0 END, b - CASE WHEN got = 1 THEN 1 ELSE 0 END, c - CASE WHEN got = 2 THEN 1 ELSE 0 END
      FROM (SELECT *, list_filter([cur % 3, (cur + 1) % 3, (cur + 2) % 3], lambda m: [a, b, c][m + 1] > 0)[1] AS got
            FROM (SELECT t.*, r.pick + 1 AS cur, least(10, r.a + g) AS a, least(10, r.b + g) AS b, least(10, r.c + g) AS c
                  FROM r JOIN (SELECT *, CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS g FROM t) t ON t.partition_id = r.partition_id AND t.k = r.k + 1))
    ) SELECT 'g0' AS group_id, partition_id, "offset", CASE WHEN sent THEN 'm' || (pick % 3) END AS member FROM r""",
)
def credit_dispatch(spark, d):
    rows = L.event_log(spark, d).select(F.lit("g0").alias("group_id"), "partition_id", "offset")
    return folds.credit_dispatch(rows, ["m0", "m1", "m2"], 10, 4)


@query(
    "circuit_breaker",
    """, t AS (SELECT CAST(user_id AS VARCHAR) AS subscription, schedule_ts AS ts, arrival, topic <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY schedule_ts, arrival) AS k FROM ev),
    b AS (
      SELECT subscription, ts, arrival, ok, CAST(0 AS BIGINT) AS k, true AS tried, 'closed' AS state, 0 AS good, 0 AS bad, CAST(0 AS BIGINT) AS until FROM t WHERE k = 1
      UNION ALL
      SELECT subscription, ts, arrival, ok, k, was <> 'open', CASE WHEN was = 'open' THEN 'open' WHEN shut THEN 'closed' WHEN trips THEN 'open' ELSE was END,
        CASE WHEN was = 'open' THEN good WHEN shut THEN 0 ELSE good + CASE WHEN ok THEN 1 ELSE 0 END END,
        CASE WHEN was = 'open' THEN bad WHEN shut THEN 0 ELSE failed END, CASE WHEN was <> 'open' AND trips THEN ts + 30000 ELSE until END
      FROM (SELECT *, ok AND was = 'half-open' AS shut, NOT ok AND (was = 'half-open' OR (good + failed >= 5 AND failed / (good + failed) >= 0.3)) AS trips
            FROM (SELECT *, bad + CASE WHEN NOT ok AND was = 'closed' THEN 1 ELSE 0 END AS failed
                  FROM (SELECT t.*, b.until, CASE WHEN b.state = 'open' AND t.ts >= b.until THEN 'half-open' ELSE b.state END AS was,
                          CASE WHEN b.state = 'open' AND t.ts >= b.until THEN 0 ELSE b.good END AS good, CASE WHEN b.state = 'open' AND t.ts >= b.until THEN 0 ELSE b.bad END AS bad
                        FROM b JOIN t ON t.subscription = b.subscription AND t.k = b.k + 1)))
    ) SELECT subscription, ts, arrival, ok, tried, state FROM b WHERE k > 0""",
)
def circuit_breaker(spark, d):
    rows = L.from_events(spark, d).select(F.col("meta")["partition_key"].alias("subscription"), F.col("schedule_ts").alias("ts"), "arrival", (F.col("topic") != "error").alias("ok"))
    return folds.circuit_breaker(rows, threshold=0.3, min_attempts=5)


@query(
    "delivery_lifecycle",
    """, t AS (SELECT user_id || '-' || (arrival % 4) AS delivery_id, arrival, schedule_ts AS sent_at, topic = 'purchase' AS ok, latency_us // 10 AS delay, row_number() OVER (PARTITION BY user_id, arrival % 4 ORDER BY arrival) AS k FROM ev),
    b AS (
      SELECT delivery_id, CAST(0 AS BIGINT) AS k, 0 AS attempts, sent_at AS ended, 'none' AS outcome FROM t WHERE k = 1
      UNION ALL
      SELECT delivery_id, k, attempts, base + CASE WHEN outcome = 'retry' THEN attempts * 1000 ELSE 0 END, outcome
      FROM (SELECT *, CASE WHEN ok AND delay <= 30000 THEN 'acked' WHEN attempts >= 5 THEN 'dead letter' ELSE 'retry' END AS outcome
            FROM (SELECT t.delivery_id, t.k, t.ok, t.delay, b.attempts + 1 AS attempts, b.ended + least(t.delay, 30000) AS base FROM b JOIN t ON t.delivery_id = b.delivery_id AND t.k = b.k + 1 WHERE b.outcome IN ('none', 'retry')))
    ) SELECT delivery_id, arg_max(outcome, k) AS outcome, CAST(max(attempts) AS INTEGER) AS attempts, arg_max(ended, k) AS ended FROM b WHERE k > 0 GROUP BY delivery_id""",
)
def delivery_lifecycle(spark, d):
    rows = L.from_events(spark, d).select(
        F.concat_ws("-", F.col("meta")["partition_key"], (F.col("arrival") % 4).cast("string")).alias("delivery_id"), F.col("arrival").alias("seq"), F.col("schedule_ts").alias("sent_at"),
        (F.col("topic") == "purchase").alias("ok"), (F.col("latency_us") / 10).cast("long").alias("delay_ms"),
    )
    return folds.final_outcomes(folds.delivery_lifecycle(rows))


@query("cdc_feed", """SELECT topic || '/' || partition_id AS key, "offset", partition_id, '{"op":"append","event":{"message_id":"' || message_id || '","schedule_ts":' || schedule_ts || ',"payload":"' || replace(props, '"', '\\"') || '","topic":"' || topic || '","offset":' || "offset" || ',"partition_id":' || partition_id || '}}' AS value FROM log""")
def cdc_feed(spark, d):
    return delivery.change_feed(L.event_log(spark, d))


@query("feed_decoded", 'SELECT topic || \'/\' || partition_id AS key, \'append\' AS op, message_id, schedule_ts, props AS payload, topic, "offset", partition_id FROM log')
def feed_decoded(spark, d):
    return delivery.read_feed(delivery.change_feed(L.event_log(spark, d)))


@query(
    "region_flushes",
    """, t AS (SELECT topic AS region, schedule_ts AS ts, arrival, arrival % 400 < 250 AS ok, row_number() OVER (PARTITION BY topic ORDER BY schedule_ts, arrival) AS k FROM ev),
    b AS (
      SELECT region, ts, arrival, ok, k, CAST(0 AS BIGINT) AS sent, CAST(0 AS BIGINT) AS dropped, CAST(1 AS BIGINT) AS pending FROM t WHERE k = 1
      UNION ALL
      SELECT region, ts, arrival, ok, k, CASE WHEN due AND ok THEN was ELSE 0 END + CASE WHEN held >= 5 AND ok THEN held ELSE 0 END,
        CASE WHEN due AND NOT ok THEN greatest(was - 12, 0) ELSE 0 END + CASE WHEN held >= 5 AND NOT ok THEN greatest(held - 12, 0) ELSE 0 END, CASE WHEN held < 5 THEN held WHEN ok THEN 0 ELSE least(held, 12) END
      FROM (SELECT *, CASE WHEN NOT due THEN was WHEN ok THEN 0 ELSE least(was, 12) END + 1 AS held
            FROM (SELECT t.*, b.pending AS was, t.ts // 3600000 > b.ts // 3600000 AND b.pending > 0 AS due FROM b JOIN t ON t.region = b.region AND t.k = b.k + 1))
    ) SELECT region, ts, arrival, ok, sent, dropped, pending FROM b""",
)
def region_flushes(spark, d):
    """Regions that are out of reach now and then: batches of five or an hour, a buffer of twelve."""
    rows = L.from_events(spark, d).select(F.col("topic").alias("region"), F.col("schedule_ts").alias("ts"), "arrival", (F.col("arrival") % 400 < 250).alias("ok"))
    return folds.region_flushes(rows, 5, 3_600_000, 12)


@query("echo_suppressed", "SELECT message_id FROM ev WHERE event_id % 4 <> 0")
def echo_suppressed(spark, d):
    region = F.when(F.col("arrival") % 4 == 0, "eu").when(F.col("arrival") % 4 == 1, "")
    rows = L.from_events(spark, d).withColumn("meta", F.map_concat("meta", F.create_map(F.lit("source_region"), region)))
    return delivery.echo_free(rows).select("message_id")


@query("retryable_codes", "SELECT code, code IN ('Unavailable', 'DeadlineExceeded', 'Aborted') AS retry FROM (VALUES ('OK'), ('Unavailable'), ('DeadlineExceeded'), ('Aborted'), ('ResourceExhausted'), ('Internal')) t(code)")
def retryable_codes(spark, d):
    rows = spark.createDataFrame([(c,) for c in ("OK", "Unavailable", "DeadlineExceeded", "Aborted", "ResourceExhausted", "Internal")], "code string")
    return rows.select("code", X.retryable(F.col("code")).alias("retry"))
