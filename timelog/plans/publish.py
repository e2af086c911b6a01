"""Publishing, dedup, last-write-wins, access and admission."""

from pyspark.sql import functions as F

from timelog.functions import bloom
from timelog.functions import scalars as X
from timelog.operators import folds, publish, schemas
from timelog.plans.registry import query
from timelog.sources import log as L

#: Rows made bad by position, in each way a rule can fail.
_BAD_SQL = """, raw AS (SELECT arrival, partition_id,
    CASE WHEN arrival % 50 = 1 THEN '' WHEN arrival % 50 = 2 THEN repeat('x', 129) ELSE user_id || '-' || topic END AS message_id,
    CASE WHEN arrival % 50 = 3 THEN repeat('t', 256) ELSE topic END AS topic,
    CASE WHEN arrival % 50 = 4 THEN 0 ELSE schedule_ts END AS schedule_ts,
    CASE WHEN arrival % 50 = 5 THEN '' ELSE props END AS payload FROM routed),
  checked AS (SELECT *, CASE WHEN message_id = '' THEN 'message_id empty' WHEN strlen(message_id) > 128 THEN 'message_id too long' WHEN strlen(topic) > 255 THEN 'topic too long'
    WHEN schedule_ts <= 0 THEN 'schedule_ts not positive' WHEN payload = '' THEN 'payload empty' END AS reject_reason FROM raw) """


def _raw(spark, d):
    n = F.col("arrival") % 50
    id_ = F.concat_ws("-", F.col("meta")["partition_key"], "topic")
    return L.from_events(spark, d).withColumns(
        {
            "message_id": F.when(n == 1, "").when(n == 2, F.repeat(F.lit("x"), 129)).otherwise(id_),
            "topic": F.when(n == 3, F.repeat(F.lit("t"), 256)).otherwise(F.col("topic")),
            "schedule_ts": F.when(n == 4, 0).otherwise(F.col("schedule_ts")),
            "payload": F.when(n == 5, F.lit(b"")).otherwise(F.col("payload")),
        }
    )


def _twins(spark, d):
    """Ids that repeat: user and event type."""
    return L.from_events(spark, d).withColumn("message_id", F.concat_ws("-", F.col("meta")["partition_key"], "topic"))


def _edits(spark, d):
    """Versions of one message per user that arrive out of order."""
    return L.from_events(spark, d).select(
        (F.col("arrival") * 7919 % 1000003).alias("arrival"), F.col("meta")["partition_key"].alias("message_id"), F.col("schedule_ts").alias("created_ts"), F.decode("payload", "UTF-8").alias("payload")
    )


_EDITS = ", edits AS (SELECT event_id * 7919 % 1000003 AS arrival, CAST(user_id AS VARCHAR) AS message_id, schedule_ts AS created_ts, props AS payload FROM ev), judged AS (SELECT *, max(created_ts) OVER (PARTITION BY message_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stored_ts FROM edits) "
_TWINS = ", twins AS (SELECT *, user_id || '-' || topic AS twin FROM routed), ranked AS (SELECT *, row_number() OVER (PARTITION BY partition_id, twin ORDER BY arrival) AS nth FROM twins) "


@query("publish_validate", _BAD_SQL + "SELECT coalesce(reject_reason, 'ok') AS reason, count(*) AS n FROM checked GROUP BY 1")
def publish_validate(spark, d):
    return publish.validated(_raw(spark, d)).groupBy(F.coalesce("reject_reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    "publish_summary",
    _BAD_SQL
    + """, firsts AS (SELECT *, row_number() OVER (PARTITION BY partition_id, message_id ORDER BY arrival) > 1 AS duplicate FROM checked WHERE reject_reason IS NULL),
    kept AS (SELECT *, row_number() OVER (PARTITION BY partition_id ORDER BY arrival) - 1 AS "offset" FROM firsts WHERE NOT duplicate)
    SELECT (SELECT count(*) FROM kept) AS published, (SELECT count(*) FROM firsts WHERE duplicate) AS duplicates, (SELECT count(*) FROM checked WHERE reject_reason IS NOT NULL) AS errors,
    coalesce((SELECT min("offset") FROM kept), -1) AS min_offset, coalesce((SELECT max("offset") FROM kept), -1) AS max_offset""",
)
def publish_summary(spark, d):
    return publish.summary_of_batch(publish.validated(_raw(spark, d)))


@query("dedup_flags", _TWINS + "SELECT arrival, partition_id, nth > 1 AS duplicate FROM ranked")
def dedup_flags(spark, d):
    return publish.first_wins(_twins(spark, d)).select("arrival", "partition_id", "duplicate")


@query("dedup_first_wins", _TWINS + "SELECT arrival, twin AS message_id, schedule_ts FROM ranked WHERE nth = 1")
def dedup_first_wins(spark, d):
    return publish.first_wins(_twins(spark, d)).where("not duplicate").select("arrival", "message_id", "schedule_ts")


@query(
    "dedup_against_history",
    _TWINS
    + """, half AS (SELECT max(arrival) // 2 AS h FROM twins), old AS (SELECT DISTINCT partition_id, twin FROM twins, half WHERE arrival <= h),
    fresh AS (SELECT t.*, row_number() OVER (PARTITION BY t.partition_id, t.twin ORDER BY arrival) AS k FROM twins t, half WHERE arrival > h AND NOT EXISTS (SELECT 1 FROM old o WHERE o.partition_id = t.partition_id AND o.twin = t.twin))
    SELECT arrival, twin AS message_id, partition_id FROM fresh WHERE k = 1""",
)
def dedup_against_history(spark, d):
    rows = _twins(spark, d)
    half = rows.agg(F.floor(F.max("arrival") / 2)).first()[0] or 0
    return publish.unseen(rows.where(F.col("arrival") > half), rows.where(F.col("arrival") <= half)).select("arrival", "message_id", "partition_id")


@query("dedup_stats", _TWINS + "SELECT partition_id, count(DISTINCT twin) AS ids, count(*) - count(DISTINCT twin) AS duplicates FROM twins GROUP BY partition_id")
def dedup_stats(spark, d):
    return _twins(spark, d).groupBy("partition_id", "message_id").agg(F.count("*").alias("n")).groupBy("partition_id").agg(F.count("*").alias("ids"), F.sum(F.col("n") - 1).alias("duplicates"))


@query(
    "dedup_with_ttl",
    """, t AS (SELECT partition_id, user_id || '-' || topic AS message_id, schedule_ts AS ts, arrival, row_number() OVER (PARTITION BY partition_id, user_id, topic ORDER BY schedule_ts, arrival) AS k FROM routed),
    b AS (
      SELECT *, false AS duplicate, ts + 604800000 AS until FROM t WHERE k = 1
      UNION ALL
      SELECT t.*, t.ts < b.until, CASE WHEN t.ts < b.until THEN b.until ELSE t.ts + 604800000 END FROM b JOIN t ON t.partition_id = b.partition_id AND t.message_id = b.message_id AND t.k = b.k + 1
    ) SELECT partition_id, message_id, ts, arrival, duplicate FROM b""",
)
def dedup_with_ttl(spark, d):
    rows = _twins(spark, d).select("partition_id", "message_id", F.col("schedule_ts").alias("ts"), "arrival")
    return folds.dedup_with_ttl(rows, 168 * 3_600_000)


@query("lww_accept_log", _EDITS + "SELECT arrival, message_id, created_ts FROM judged WHERE stored_ts IS NULL OR created_ts > stored_ts")
def lww_accept_log(spark, d):
    return publish.accept_newer(_edits(spark, d)).where("accepted").select("arrival", "message_id", "created_ts")


@query("lww_final_state", _EDITS + "SELECT message_id, max(created_ts) AS created_ts, arg_max(arrival, (created_ts, -arrival)) AS arrival, arg_max(payload, (created_ts, -arrival)) AS payload FROM edits GROUP BY message_id")
def lww_final_state(spark, d):
    return publish.newest_state(_edits(spark, d))


@query("conflict_counts", _EDITS + "SELECT CASE WHEN stored_ts IS NULL THEN 'no_conflict' WHEN created_ts > stored_ts THEN 'lww_replaced' ELSE 'lww_kept' END AS resolution, count(*) AS n FROM judged GROUP BY 1")
def conflict_counts(spark, d):
    return publish.conflict_counts(_edits(spark, d))


@query("exactly_once_commits", "SELECT user_id || ':' || (event_id % 7) AS commit_id, min(event_id) AS seq, arg_min(schedule_ts, event_id) AS next_offset FROM ev GROUP BY 1")
def exactly_once_commits(spark, d):
    rows = L.from_events(spark, d).select(F.concat_ws(":", F.col("meta")["partition_key"], (F.col("arrival") % 7).cast("string")).alias("commit_id"), F.col("arrival").alias("seq"), F.col("schedule_ts").alias("next_offset"))
    return publish.once_per_commit(rows)


@query(
    "monotone_acks",
    """, acks AS (SELECT topic AS group_id, partition_id, arrival AS seq, "offset" * 7919 % 1000003 AS next_offset FROM log),
    j AS (SELECT *, max(next_offset) OVER (PARTITION BY group_id, partition_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM acks)
    SELECT group_id, partition_id, seq, next_offset FROM j WHERE c IS NULL OR next_offset > c""",
)
def monotone_acks(spark, d):
    acks = L.event_log(spark, d).select(F.col("topic").alias("group_id"), "partition_id", F.col("arrival").alias("seq"), (F.col("offset") * 7919 % 1000003).alias("next_offset"))
    return publish.forward_acks(acks).drop("committed")


@query("rbac_filter", "SELECT arrival, 'user-' || (user_id % 3) AS subject, topic FROM ev WHERE (user_id % 3 = 0 AND topic IN ('click', 'view')) OR user_id % 3 = 1")
def rbac_filter(spark, d):
    rows = L.from_events(spark, d).select("arrival", F.concat(F.lit("user-"), (F.col("meta")["partition_key"].cast("long") % 3).cast("string")).alias("subject"), "topic")
    policy = spark.createDataFrame([("user-0", "click", ["publish"]), ("user-0", "view", ["publish", "read"]), ("user-1", "*", ["publish"]), ("user-2", "click", ["read"])], "subject string, topic string, actions array<string>")
    return publish.allowed(rows, policy, "publish").select("arrival", "subject", "topic")


@query("admin_filter", "SELECT arrival, 'user-' || (user_id % 4) AS subject FROM ev WHERE user_id % 4 IN (1, 3)")
def admin_filter(spark, d):
    rows = L.from_events(spark, d).select("arrival", F.concat(F.lit("user-"), (F.col("meta")["partition_key"].cast("long") % 4).cast("string")).alias("subject"))
    subjects = spark.createDataFrame([("user-0", False), ("user-1", True), ("user-3", True)], "subject string, admin boolean")
    return publish.administrators(rows, subjects)


@query("key_bounds", "SELECT message_id, CAST(user_id AS VARCHAR) AS key FROM ev WHERE CAST(user_id AS VARCHAR) >= '12' AND CAST(user_id AS VARCHAR) < '30'")
def key_bounds(spark, d):
    rows = L.from_events(spark, d).select("message_id", F.col("meta")["partition_key"].alias("key"))
    return rows.where(X.key_in_bounds(F.col("key"), F.lit("12"), F.lit("30")))


@query(
    "admission_check",
    "SELECT partition_id, NOT (ready + 100 > 1000 OR ready + 100 >= 800 OR wheel + 100 > 100000) AS accept FROM (SELECT partition_id, count(*) FILTER (schedule_ts <= 1705276800000) AS ready, count(*) FILTER (schedule_ts > 1705276800000) AS wheel FROM log GROUP BY 1)",
)
def admission_check(spark, d):
    due = F.col("schedule_ts") <= 1705276800000
    depths = L.event_log(spark, d).groupBy("partition_id").agg(F.count_if(due).alias("ready"), F.count_if(~due).alias("wheel"), F.lit(0).alias("in_flight"))
    return publish.admitted(depths, 100, 1000, 0.8, 100_000, 0).select("partition_id", "accept")


@query(
    "write_fences",
    "SELECT partition_id, count(*) AS n, CASE WHEN partition_id = 6 THEN 'splitting' WHEN partition_id = 7 THEN 'stale epoch' WHEN partition_id % 3 <> 0 THEN 'not leader' END AS fence FROM routed GROUP BY partition_id",
)
def write_fences(spark, d):
    ids = spark.range(8).select(F.col("id").cast("int").alias("partition_id"))
    nodes = F.array(F.lit("node-0"), F.lit("node-1"), F.lit("node-2"))
    leader = F.when(F.col("partition_id") == 7, "node-0").otherwise(F.concat(F.lit("node-"), (F.col("partition_id") % 3).cast("string")))
    a = ids.select("partition_id", leader.alias("leader_id"), F.lit(5).alias("epoch"), F.when(F.col("partition_id") == 7, 4).otherwise(5).alias("local_epoch"), (F.col("partition_id") == 6).alias("splitting"), nodes.alias("replicas"))
    return publish.writable(L.from_events(spark, d), a, "node-0").groupBy("partition_id", "fence").agg(F.count("*").alias("n"))


#: Folds in SQL: rows of a key are numbered, and a recursive table takes one row of each key at a time.
@query(
    "token_bucket",
    """, t AS (SELECT topic, schedule_ts AS ts, arrival, row_number() OVER (PARTITION BY topic ORDER BY schedule_ts, arrival) AS k FROM ev),
    b AS (
      SELECT topic, ts, arrival, k, true AS allowed, CAST(19 AS BIGINT) AS tokens, ts AS last FROM t WHERE k = 1
      UNION ALL
      SELECT topic, ts, arrival, k, free >= 1, free - CASE WHEN free >= 1 THEN 1 ELSE 0 END, CASE WHEN refill > 0 THEN ts ELSE last END
      FROM (SELECT *, CASE WHEN refill > 0 THEN least(20, tokens + refill) ELSE tokens END AS free
            FROM (SELECT t.topic, t.ts, t.arrival, t.k, b.last, b.tokens, greatest(0, t.ts - b.last) // 1000 AS refill FROM b JOIN t ON t.topic = b.topic AND t.k = b.k + 1))
    ) SELECT topic, ts, arrival, 1 AS n, allowed, tokens FROM b""",
)
def token_bucket(spark, d):
    rows = L.from_events(spark, d).select("topic", F.col("schedule_ts").alias("ts"), "arrival", F.lit(1).alias("n"))
    return folds.token_bucket(rows, ["topic"], 20, 1)


@query(
    "client_rate_limit",
    """, t AS (SELECT user_id % 20 AS client, schedule_ts AS ts, arrival, row_number() OVER (PARTITION BY user_id % 20 ORDER BY schedule_ts, arrival) AS k FROM ev),
    b AS (
      SELECT client, ts, arrival, k, true AS allowed, CAST(2000000 AS BIGINT) AS micro FROM t WHERE k = 1
      UNION ALL
      SELECT client, ts, arrival, k, free >= 1000000, CASE WHEN free >= 1000000 THEN free - 1000000 ELSE micro END
      FROM (SELECT t.*, b.micro, least(3000000, b.micro + CAST(trunc((t.ts - b.ts) * 1000000 * (0.0002::DOUBLE / 1000)) AS BIGINT)) AS free FROM b JOIN t ON t.client = b.client AND t.k = b.k + 1)
    ) SELECT client, ts, arrival, allowed FROM b""",
)
def client_rate_limit(spark, d):
    rows = L.from_events(spark, d).select((F.col("meta")["partition_key"].cast("long") % 20).alias("client"), F.col("schedule_ts").alias("ts"), "arrival")
    return folds.client_bucket(rows, 3.0, 0.0002)


@query(
    "topic_rate_limit",
    """, t AS (SELECT CAST(user_id AS VARCHAR) AS subject, topic, schedule_ts AS ts, arrival, row_number() OVER (PARTITION BY user_id, topic ORDER BY schedule_ts, arrival) AS k FROM ev),
    b AS (
      SELECT subject, topic, ts, arrival, k, true AS allowed, CAST(1 AS DOUBLE) AS tokens FROM t WHERE k = 1
      UNION ALL
      SELECT subject, topic, ts, arrival, k, free >= 1, free - CASE WHEN free >= 1 THEN 1 ELSE 0 END
      FROM (SELECT t.*, least(2::DOUBLE, b.tokens + (t.ts - b.ts) / 1000 * 0.0001::DOUBLE) AS free FROM b JOIN t ON t.subject = b.subject AND t.topic = b.topic AND t.k = b.k + 1)
    ) SELECT subject, topic, ts, arrival, 1 AS n, allowed FROM b""",
)
def topic_rate_limit(spark, d):
    rows = L.from_events(spark, d).select(F.col("meta")["partition_key"].alias("subject"), "topic", F.col("schedule_ts").alias("ts"), "arrival", F.lit(1).alias("n"))
    return folds.smooth_bucket(rows, ["subject", "topic"], 2.0, 0.0001)


#: Every tenant but one in five has limits: 2 events a second, 50 in flight, 400 bytes.
@query(
    "tenant_reserve",
    """, t AS (SELECT CAST(user_id AS VARCHAR) AS tenant, user_id % 5 > 0 AS bound, schedule_ts AS ts, arrival, CAST(strlen(props) AS BIGINT) AS size, row_number() OVER (PARTITION BY user_id ORDER BY schedule_ts, arrival) AS k FROM ev),
    b AS (
      SELECT tenant, bound, ts, arrival, k, NOT bound OR size <= 400 AS reserved, CASE WHEN bound AND size > 400 THEN 'storage' END AS reason,
        CASE WHEN size <= 400 THEN 1 ELSE 2 END::DOUBLE AS tokens, ts AS last, CASE WHEN size <= 400 THEN 1 ELSE 0 END::BIGINT AS flight, CASE WHEN size <= 400 THEN size ELSE 0 END AS bytes FROM t WHERE k = 1
      UNION ALL
      SELECT tenant, bound, ts, arrival, k, NOT bound OR why IS NULL, CASE WHEN bound THEN why END, CASE WHEN why IS NULL THEN free - 1 ELSE free END, ts,
        flight + CASE WHEN why IS NULL THEN 1 ELSE 0 END, bytes + CASE WHEN why IS NULL THEN size ELSE 0 END
      FROM (SELECT *, CASE WHEN free < 1 THEN 'rate' WHEN flight + 1 > 50 THEN 'in flight' WHEN bytes + size > 400 THEN 'storage' END AS why
            FROM (SELECT t.*, b.flight, b.bytes, least(2::DOUBLE, b.tokens + (t.ts - b.last) / 1000 * 2::DOUBLE) AS free FROM b JOIN t ON t.tenant = b.tenant AND t.k = b.k + 1))
    ) SELECT tenant, ts, arrival, reserved, reason FROM b""",
)
def tenant_reserve(spark, d):
    rows = L.from_events(spark, d).select(F.col("meta")["partition_key"].alias("tenant"), F.col("schedule_ts").alias("ts"), "arrival", F.lit(1).alias("n"), F.length("payload").cast("long").alias("bytes"))
    limits = rows.select("tenant").distinct().select("tenant", F.lit(2.0).alias("max_events_per_second"), F.lit(50).cast("long").alias("max_in_flight"), F.lit(400).cast("long").alias("max_storage_bytes")).where(F.col("tenant").cast("long") % 5 > 0)
    return folds.tenant_reserve(rows, limits).select("tenant", "ts", "arrival", "reserved", "reason")


@query(
    "tenant_usage",
    "SELECT tenant, events, CAST(bytes AS BIGINT) AS bytes FROM (SELECT CAST(user_id AS VARCHAR) AS tenant, count(*) AS events, sum(strlen(props)) AS bytes FROM ev GROUP BY ROLLUP (1))",
)
def tenant_usage(spark, d):
    return L.from_events(spark, d).select(F.col("meta")["partition_key"].alias("tenant"), "payload").rollup("tenant").agg(F.count("*").alias("events"), F.sum(F.length("payload")).cast("long").alias("bytes"))


@query("all_tenants", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS tenant FROM ev UNION SELECT 'limit-' || i FROM range(5) t(i) UNION SELECT '7'")
def all_tenants(spark, d):
    usage = L.from_events(spark, d).select(F.col("meta")["partition_key"].alias("tenant"))
    limits = spark.range(5).select(F.concat(F.lit("limit-"), F.col("id").cast("string")).alias("tenant")).unionByName(spark.createDataFrame([("7",)], "tenant string"))
    return publish.tenants(limits, usage)


_BLOOM_BITS, _BLOOM_HASHES = bloom.sizing(600, 0.05)
_BLOOM_AT = f"list_transform(range({_BLOOM_HASHES}), lambda i: CAST((h1 + i::UHUGEINT * h2) % 18446744073709551616::UHUGEINT % {_BLOOM_BITS}::UHUGEINT AS BIGINT))"


def _fnv_from(start: str) -> str:
    return f"list_reduce(list_prepend({start}::UHUGEINT, list_transform(string_split(k, ''), lambda x: ascii(x)::UHUGEINT)), lambda h, c: (xor(h, c) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"


@query(
    "bloom_probe",
    f""", k AS (SELECT DISTINCT user_id || '-' || topic AS k, user_id % 3 = 0 AS there FROM ev),
    h AS (SELECT k, there, {_fnv_from("14695981039346656037")} AS h1, {_fnv_from("((xor(14695981039346656037::UHUGEINT, 11259375::UHUGEINT) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)")} AS h2 FROM k),
    p AS (SELECT k, there, unnest({_BLOOM_AT}) AS pos FROM h), bits AS (SELECT DISTINCT pos FROM p WHERE there),
    m AS (SELECT k, there, bool_and(pos IN (SELECT pos FROM bits)) AS maybe FROM p GROUP BY ALL)
    SELECT count(*) FILTER (there) AS items, (SELECT count(*) FROM bits) AS bits_set, count(*) AS lookups, count(*) FILTER (NOT maybe) AS rejected, count(*) FILTER (maybe AND NOT there) AS false_positives,
      count(*) FILTER (maybe AND there) AS hits, count(*) FILTER (maybe) >= 1000 AND count(*) FILTER (maybe AND NOT there) / greatest(count(*) FILTER (maybe), 1) > 0.05 AS worn_out FROM m""",
)
def bloom_probe(spark, d):
    """A filter of every third user's ids, asked for all ids."""
    rows = _twins(spark, d)
    known = rows.where(F.col("meta")["partition_key"].cast("long") % 3 == 0)
    out = bloom.probe(known, rows, "message_id", _BLOOM_BITS, _BLOOM_HASHES)
    return out.withColumn("worn_out", bloom.worn_out(F.col("hits"), F.col("false_positives")))


def _schemas(spark):
    kind = '{{"type":"object","properties":{{"k":{{"type":"{}"}}}}}}'
    rows = [("click", 1, "json", kind.format("string")), ("click", 2, "json", kind.format("integer")), ("view", 1, "json", kind.format("string")), ("error", 1, "avro", '{"type":"record","fields":[{"name":"k"}]}'), ("error", 2, "avro", '{"type":"record","fields":[]}')]
    return spark.createDataFrame(rows, "topic string, version int, type string, definition string")


# `click` wants an integer k, `view` a string, and the other topics have no JSON schema.
@query(
    "payload_json_valid",
    "SELECT topic, CASE topic WHEN 'click' THEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') WHEN 'view' THEN json_type(props, '$.k') = 'VARCHAR' ELSE true END AS schema_ok, count(*) AS n FROM ev GROUP BY 1, 2",
)
def payload_json_valid(spark, d):
    return schemas.validated(L.from_events(spark, d), _schemas(spark)).groupBy("topic", "schema_ok").agg(F.count("*").alias("n"))


@query("latest_schema", "SELECT * FROM (VALUES ('click', 2, 'json'), ('view', 1, 'json'), ('error', 2, 'avro')) t(topic, version, type)")
def latest_schema(spark, d):
    return schemas.latest(_schemas(spark)).select("topic", "version", "type")


@query("schema_problems", "SELECT * FROM (VALUES ('click', 2, 'k: type changed from string to integer'), ('error', 2, 'field k has no default')) t(topic, version, problem)")
def schema_problems(spark, d):
    return schemas.incompatible_versions(_schemas(spark))
