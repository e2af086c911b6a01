"""Hand fixtures and plain models for operators that SQL does not cover."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from timelog import schema as S
from timelog.functions import bloom
from timelog.functions import scalars as X
from timelog.functions.running import stretches, with_highest_before, with_rank, with_running, within
from timelog.operators import cluster, folds, groups, lifecycle, publish, schemas
from timelog.sources import files, wal
from timelog.sources import log as L
from timelog.streaming import jobs


def test_running_over_blocks(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), n, rng.randrange(50)) for n in rng.sample(range(5000), 300)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    got = with_rank(with_running(df, ["k"], "o", [], {"s": F.col("v")}, block=64), ["k"], "o", "r", block=64)
    got = {(r.k, r.o): (r.s, r.r, r.h) for r in with_highest_before(got, ["k"], "o", "v", "h", block=64).collect()}
    for k in "ab":
        total, high = 0, None
        for n, (_, o, v) in enumerate(sorted(x for x in rows if x[0] == k)):
            total += v
            assert got[k, o] == (total, n, high)
            high = v if high is None else max(high, v)


def test_ranges_meet_rows_by_blocks(spark):
    """Rows within ranges that touch, overlap, stand alone and span blocks; the join's keys hold the block, so rows don't meet all ranges of their partition."""
    rng = random.Random(9)
    ranges = [(p, a, a + rng.choice([0, 0, 3, 40])) for p in (0, 1) for a in rng.sample(range(600), 40)] + [(2, 0, 599)]
    segs = spark.createDataFrame(ranges, "p int, a long, z long")
    rows = spark.range(4 * 700).select((F.col("id") % 4).cast("int").alias("p"), F.floor(F.col("id") / 4).alias("o"))
    got = within(rows, "o", segs, ["p"], "a", "z", block=16)
    want = [(p, o) for p in range(4) for o in range(700) if any(q == p and a <= o <= z for q, a, z in ranges)]
    assert sorted(map(tuple, got.collect())) == want
    joins = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "LeftSemi" in x]
    assert joins and all("FLOOR" in x.split("LeftSemi")[0] for x in joins)
    held = [r for r in stretches(segs, ["p"], "a", "z").orderBy("p", "a").collect()]
    assert all(x.p != y.p or x.z + 1 < y.a for x, y in zip(held, held[1:])) and held[-1][:] == (2, 0, 599)


def test_restore_shuffles_once(spark, tmp_path):
    """Backups that overlap give each row back once, by one shuffle, in files sorted by offset."""
    log = spark.range(900).select((F.col("id") % 3).cast("int").alias("partition_id"), F.floor(F.col("id") / 3).alias("offset"), F.create_map(F.lit("k"), F.col("id").cast("string")).alias("meta"))
    for checkpoint in (250, 90):
        segs = spark.createDataFrame([(p, n, n + 9) for p in range(3) for n in range(checkpoint, 300, 20)], "partition_id int, first_offset long, last_offset long")
        files.backup(log, segs, f"{tmp_path}/b")
    seen = []
    write = files._write_ranges
    try:
        files._write_ranges = lambda ranges, *a: (seen.append(ranges._jdf.queryExecution().executedPlan().toString()), write(ranges, *a))
        files.restore(spark, f"{tmp_path}/b", f"{tmp_path}/r", log.schema)
    finally:
        files._write_ranges = write
    assert len(seen) == 1 and seen[0].count("Exchange ") == 1
    got = files.read_log(spark, f"{tmp_path}/r", log.schema).collect()
    spans = {o for c in (250, 90) for n in range(c, 300, 20) for o in range(n, n + 10)}
    assert sorted((r.partition_id, r.offset, r.meta["k"]) for r in got) == sorted((p, o, str(3 * o + p)) for p in range(3) for o in spans)


def test_validation_order_and_lengths(spark):
    rows = [("", "t", b"x", 1), ("i" * 128, "t", b"x", 1), ("ä" * 65, "t", b"x", 1), ("i", "t" * 255, b"x", 1), ("i", "t" * 256, b"x", 1), ("i", "t", b"x", 0), ("i", "t", b"", 1), ("", "t" * 256, b"", 0)]
    df = spark.createDataFrame(rows, "message_id string, topic string, payload binary, schedule_ts long")
    got = [r.reject_reason for r in publish.validated(df).collect()]
    assert got == ["message_id empty", None, "message_id too long", None, "topic too long", "schedule_ts not positive", "payload empty", "message_id empty"]


def test_dedup_and_last_write_wins(spark):
    df = spark.createDataFrame([(0, 0, "same"), (1, 0, "same"), (2, 0, "other"), (3, 1, "same")], "arrival long, partition_id int, message_id string")
    assert {r.arrival: r.duplicate for r in publish.first_wins(df).collect()} == {0: False, 1: True, 2: False, 3: False}
    edits = spark.createDataFrame([(1, "e", 1000, "a"), (2, "e", 500, "b"), (3, "e", 2000, "c"), (4, "e", 2000, "d")], "arrival long, message_id string, created_ts long, payload string")
    assert sorted(r.arrival for r in publish.accept_newer(edits).where("accepted").collect()) == [1, 3]
    assert publish.newest_state(edits).first().payload == "c"


def test_empty_log_and_single_row(spark):
    empty = spark.createDataFrame([], "partition_id int, offset long")
    parts = spark.createDataFrame([(0,), (1,)], "partition_id int")
    one = spark.createDataFrame([(0, 0)], "partition_id int, offset long")
    assert groups.high_watermarks(empty).count() == 0
    got = {r.partition_id: (r.hwm, r.last_offset, r.next_offset) for r in groups.high_watermarks(one, parts).collect()}
    assert got == {0: (0, 0, 1), 1: (0, -1, 0)}
    marks = groups.high_watermarks(one, parts)
    lag = groups.lag(spark.createDataFrame([("g", 1, -1), ("g", 9, 3)], "group_id string, partition_id int, committed long"), marks)
    assert {r.partition_id: (r.lag, r.backlog) for r in lag.collect()} == {1: (1, 0), 9: (-1, -1)}


def test_replay_bounds(spark):
    log = spark.createDataFrame([(0, n, 100 * n) for n in range(5)], "partition_id int, offset long, schedule_ts long")
    assert sorted(r.offset for r in L.time_range(log, 100, 300).collect()) == [1, 2, 3]
    assert sorted(r.offset for r in L.replay_offsets(log, 0, 0, 3).collect()) == [0, 1, 2]
    assert L.replay_offsets(log, 0, 9, 3).count() == 0
    assert L.replay_times(log, 0, 0, None, 200).count() == 3


def test_election_leaves_out_the_old_leader(spark):
    """The old leader is no candidate even if it lives and leads in offsets; ties go to the least id; without candidates there is no leader."""
    at = {"w1": 70, "w2": 64, "w3": 64, "w4": 69}
    rows = [(0, "w1", list(at), ["w1", "w3", "w2"], at), (1, "w1", list(at), ["w1"], at), (2, "w4", ["w4"], ["w4"], at), (3, "w2", list(at), [], None)]
    a = spark.createDataFrame(rows, "partition_id int, leader_id string, replicas array<string>, isr array<string>, replica_offsets map<string,long>")
    alive = spark.createDataFrame([(x,) for x in at], "node_id string")
    assert {r.partition_id: r.new_leader for r in cluster.failover(a, alive).collect()} == {0: "w2", 1: "w4", 2: None, 3: "w1"}


def test_election_invariants(spark):
    rng = random.Random(7)
    nodes = [f"n{i}" for i in range(5)]
    alive = set(rng.sample(nodes, 3))
    states = [(p, rng.choice(nodes), nodes, rng.sample(nodes, rng.randrange(6)), {n: rng.randrange(9) for n in nodes}) for p in range(1000)]
    a = spark.createDataFrame(states, "partition_id int, leader_id string, replicas array<string>, isr array<string>, replica_offsets map<string,long>")
    got = {r.partition_id: r.new_leader for r in cluster.failover(a, spark.createDataFrame([(n,) for n in alive], "node_id string")).collect()}
    for p, old, _, isr, at in states:
        pool = [n for n in isr if n in alive and n != old] or [n for n in alive if n != old]
        assert got[p] == min(pool, key=lambda n: (-at[n], n))


def test_ring_moves_few_keys(spark):
    keys = spark.range(1000).select(F.concat(F.lit("key-"), F.col("id").cast("string")).alias("key"))
    nodes = lambda n: spark.range(n).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("node_id"), F.lit("").alias("rack"))
    before, after = ({r.key: r.owner for r in cluster.owners(keys, cluster.ring(spark, nodes(n))).collect()} for n in (3, 4))
    assert len(before) == len(after) == 1000
    assert sum(before[k] != after[k] for k in before) < 500
    assert all(after[k] == "n3" for k in before if before[k] != after[k])
    reps = {r.key: r.replicas for r in cluster.replicas(keys, cluster.ring(spark, nodes(4)), 3).collect()}
    assert all(len(set(v)) == 3 and v[0] == after[k] for k, v in reps.items())


def test_token_bucket_model(spark):
    rng = random.Random(5)
    rows, t = [], 0
    for n in range(400):
        t += rng.randrange(900)
        rows.append((rng.choice("ab"), t, n, rng.randrange(1, 4)))
    df = spark.createDataFrame(rows, "k string, ts long, arrival long, n long")
    got = {r.arrival: r.allowed for r in folds.token_bucket(df, ["k"], 5, 2).collect()}
    for k in "ab":
        tokens, last = 5, None
        for _, ts, arrival, n in [r for r in rows if r[0] == k]:
            last = ts if last is None else last
            refill = (ts - last) * 2 // 1000
            if refill:
                tokens, last = min(5, tokens + refill), ts
            assert got[arrival] == (tokens >= n)
            tokens -= n if tokens >= n else 0


def test_tenant_refund(spark):
    rows = spark.createDataFrame([("t", 0, 1, 2, 60), ("t", 0, 2, 2, 60), ("t", 0, 3, 2, 10), ("free", 0, 4, 99, 99)], "tenant string, ts long, arrival long, n long, bytes long")
    limits = spark.createDataFrame([("t", 4.0, 10, 100)], "tenant string, max_events_per_second double, max_in_flight long, max_storage_bytes long")
    got = {r.arrival: (r.reserved, r.reason) for r in folds.tenant_reserve(rows, limits).collect()}
    assert got == {1: (True, None), 2: (False, "storage"), 3: (True, None), 4: (True, None)}


def test_fold_after_an_adaptive_join(spark):
    """A key is one task even if the rows come from a join on it that turns into a broadcast while it runs, and is then read as the mappers wrote it."""
    rows = spark.range(0, 400, 1, 8).select(F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("tenant"), F.col("id").alias("ts"), F.col("id").alias("arrival"), F.lit(1).alias("n"), F.lit(1).alias("bytes"))
    limits = spark.createDataFrame([(f"t{i}", 0.0, 20, 0) for i in range(3)], "tenant string, max_events_per_second double, max_in_flight long, max_storage_bytes long")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = folds.tenant_reserve(rows, limits).where("reserved").collect()
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert sorted(r.arrival for r in got) == list(range(60))


def test_breaker_opens_and_recovers(spark):
    oks = [False] * 10 + [True, True, False, True]
    times = list(range(10)) + [11, 40_000, 40_001, 40_002]
    df = spark.createDataFrame([("s", t, n, ok) for n, (t, ok) in enumerate(zip(times, oks))], "subscription string, ts long, arrival long, ok boolean")
    got = [(r.tried, r.state) for r in folds.circuit_breaker(df).orderBy("arrival").collect()]
    assert got[9:] == [(True, "open"), (False, "open"), (True, "closed"), (True, "closed"), (True, "closed")]


def test_acks_of_many_batches(spark, tmp_path):
    """Deliveries end as a plain model of one state each says, over batches with timeouts between; the stream keeps a state for a bucket of them."""
    rng = random.Random(11)
    base, ids = 1_700_000_000, [f"d{i}" for i in range(200)] + [None]
    batches = [[(rng.choice(ids), rng.choice(["sent", "ack", "ack", None]), rng.choice([True, False, False, False, None]), base + 100 * b) for _ in range(150)] for b in range(5)]
    for b, rows in enumerate(batches):
        spark.createDataFrame(rows, "delivery_id string, kind string, ok boolean, at long").withColumn("at", F.timestamp_seconds("at")).coalesce(1).write.parquet(f"{tmp_path}/in/{b}")
        for f in (tmp_path / "in" / str(b)).glob("*.parquet"):
            os.utime(f, (base + b, base + b))
    want, held, now = [], {}, 0
    for rows in [*batches, []]:
        due = {k: (n, t) for k, (n, t) in held.items() if k not in {r[0] for r in rows} and t < now}
        for k in {r[0] for r in rows} | set(due):
            said = [bool(r[2]) for r in rows if r[0] == k and r[1] == "ack"]
            n = held.pop(k, (0, 0))[0] + (k in due) + said.count(False)
            if any(said) or n >= 5:
                want.append((k, "acked", n + 1) if any(said) else (k, "dead letter", n))
            else:
                held[k] = (n, now + 30_000 * max(1, n))
        now = max([now, *(r[3] * 1000 for r in rows)])
    got = []
    stream = spark.readStream.schema("delivery_id string, kind string, ok boolean, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    run = jobs.ack_tracking(stream, late="0 seconds", buckets=8).writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state")
    run = run.foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).start()
    run.awaitTermination()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    order = lambda r: (str(r[0]), *r[1:])
    assert sorted(got, key=order) == sorted(want, key=order) and {r[1] for r in want} == {"acked", "dead letter"}
    assert max(sizes) == 8 < len(held)


def test_delivery_series(spark):
    rows = [("a", 1, 0, False, None)] * 0 + [("a", n, 0, n == 3, 5) for n in range(1, 5)] + [("b", n, 0, False, None) for n in range(1, 7)]
    df = spark.createDataFrame(rows, "delivery_id string, seq long, sent_at long, ok boolean, delay_ms long")
    got = {r.delivery_id: (r.outcome, r.attempts, r.ended) for r in folds.final_outcomes(folds.delivery_lifecycle(df)).collect()}
    assert got == {"a": ("acked", 3, 15 + 1000 + 2000), "b": ("dead letter", 5, 150_000 + 10_000)}


@pytest.mark.parametrize("old, new, mode, ok", [
    ({"fields": [{"name": "a"}]}, {"fields": [{"name": "a"}, {"name": "b", "default": 0}]}, "BACKWARD", True),
    ({"fields": [{"name": "a"}, {"name": "b"}]}, {"fields": [{"name": "a"}]}, "BACKWARD", False),
    ({"fields": [{"name": "a"}]}, {"fields": []}, "NONE", True),
    ({"fields": [{"name": "a"}]}, {"fields": [{"name": "a"}, {"name": "b"}]}, "FORWARD", False),
    ({"fields": [{"name": "a", "default": 1}]}, {"fields": [{"name": "b"}]}, "FULL", False),
])
def test_avro_compatibility(old, new, mode, ok):
    assert (not schemas.problems("avro", json.dumps(old), "avro", json.dumps(new), mode)) == ok


def test_json_rules():
    a = {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}}}
    b = {"type": "object", "properties": {"x": {"type": "integer"}}}
    assert schemas.problems("json", json.dumps(a), "json", json.dumps(b)) and not schemas.problems("json", json.dumps(a), "json", json.dumps(b), "FORWARD")
    assert schemas.problems("json", "{}", "avro", "{}") and schemas.payload_fits(None, b"\xff") and schemas.payload_fits(json.dumps(a), b"{}")
    assert not schemas.payload_fits(json.dumps(a), b"{}", strict=True) and schemas.payload_fits(json.dumps(a), b'{"x": 2.0}') and not schemas.payload_fits(json.dumps(a), b'{"x": 2.5}')
    assert not schemas.payload_fits('{"type":"array","items":{"type":"string"}}', b'["a", 1]') and not schemas.payload_fits("{}", b"{")


def test_incompatible_versions(spark):
    """Only neighbouring versions are held against each other, several problems are several rows, and none is no row."""
    field = lambda *names: json.dumps({"type": "record", "fields": [{"name": n} for n in names]})
    rows = [("a", 1, "avro", field("x", "y")), ("a", 3, "avro", field()), ("a", 7, "avro", field()), ("b", 1, "avro", field("x")), ("b", 2, "json", "{}"), ("c", 1, "json", "{}"), ("d", 1, "json", "{}"), ("d", 2, "json", "{}")]
    versions = spark.createDataFrame(rows, "topic string, version int, type string, definition string")
    got = schemas.incompatible_versions(versions)
    assert got.schema.simpleString() == "struct<topic:string,version:int,problem:string>"
    assert sorted(map(tuple, got.collect())) == [("a", 3, "field x has no default"), ("a", 3, "field y has no default"), ("b", 2, "schema type changed from avro to json")]
    assert schemas.incompatible_versions(versions.where("topic = 'c'")).count() == 0


def test_wal_stops_at_damage():
    good = [wal.encode(n, n, f"m{n}", "t", b"p" * n, {"k": "ü"}) for n in range(1, 4)]
    bad = bytearray(b"".join(good))
    bad[len(good[0]) + 20] ^= 1
    got = list(wal.decode(bytes(bad)))
    assert [g[1] for g in got] == [True, False]
    assert [g[5] for g in wal.decode(b"".join(good) + b"\x00\x00")][:3] == ["m1", "m2", "m3"]
    header = wal.encode_header(5, 9)
    assert wal.decode_header(header)["first_offset"] == 5 and wal.decode_header(b"x" + header[1:12] + b"?" + header[13:]) is None


def test_files_round_trip(spark, sf_dir, tmp_path):
    log = L.event_log(spark, sf_dir)
    files.write_log(log, f"{tmp_path}/log")
    back = files.read_log(spark, f"{tmp_path}/log")
    assert back.count() == log.count()
    with pytest.raises(ValueError):
        files.append_replicated(back, back.limit(1), f"{tmp_path}/log")
    for n, data in enumerate([wal.encode(0, 1, "a", "t", b"x"), wal.encode(1, 1, "b", "t", b"x") + b"junk"]):
        (tmp_path / f"{n}.log").write_bytes(data)
    rows = wal.read_wal(spark, f"{tmp_path}/*.log")
    assert rows.where("valid").count() == 2 and rows.where("not valid").count() == 1


def test_split_keeps_source(spark):
    keys = ["k4", "k1", "k9", "k6", "k9", "", "k7"]
    rows = [(3, n, f"row{n}", {"partition_key": k}) for n, k in enumerate(keys)] + [(4, 0, "other", {"partition_key": "k9"})]
    log = spark.createDataFrame(rows, "partition_id int, offset long, message_id string, meta map<string,string>")
    got = lifecycle.split(log, 3, 1, "k6", 8).orderBy("offset").collect()
    # An empty key stands for the message id, which sorts after k6.
    assert [(r.message_id, r.source_offset, r.offset, r.partition_id) for r in got] == [(f"row{n}", n, k, 8) for k, n in enumerate([2, 3, 4, 5, 6])]


def plain_fetch(sizes, start, budget):
    """Batches as a loop of reads sends them: [(offsets, has_more)]."""
    out, at, sent = [], start, 0
    while sent < budget:
        got = [o for o in range(at, at + 101) if o < len(sizes)]
        if not got:
            break
        sent += sum(sizes[o] for o in got)
        out.append((got, sent < budget and at + 100 < len(sizes)))
        at += len(got)
    return out


@pytest.mark.parametrize("n, start, budget", [(350, 7, 900), (350, 0, 10_000), (303, 0, 10_000), (202, 0, 1), (90, 95, 50), (250, 149, 700)])
def test_fetch_batches(spark, n, start, budget):
    rng = random.Random(n)
    sizes = [rng.randrange(1, 9) for _ in range(n)]
    log = spark.createDataFrame([(2, o, b"x" * size) for o, size in enumerate(sizes)] + [(1, 0, b"yy")], "partition_id int, offset long, payload binary")
    got = {}
    for r in L.fetch(log, 2, start, budget).collect():
        got.setdefault((r.batch, r.has_more), []).append(r.offset)
    assert sorted((b, sorted(o), m) for (b, m), o in got.items()) == [(b, o, m) for b, (o, m) in enumerate(plain_fetch(sizes, start, budget))]


def test_batch_checksum_bytes(spark):
    import struct
    import zlib

    rows = [(5, 2, None, b"one"), (6, 2, 0, b""), (7, 3, 99, b"three")]
    df = spark.createDataFrame(rows, "offset long, term long, checksum long, payload binary")
    got = df.agg(F.array_sort(F.collect_list(F.struct("offset", "term", "checksum", "payload"))).alias("rows")).select(X.batch_checksum(F.col("rows")).alias("c")).first().c
    data = b"".join(struct.pack(">QQI", o, t, c or zlib.crc32(p)) + p for o, t, c, p in rows)
    assert got == zlib.crc32(data)


def test_segments_overshoot(spark):
    """A segment ends after the row that fills it, however far that row overshoots, and the next one starts from nothing."""
    rows = [(0, n, size) for n, size in enumerate([60, 60, 250, 10, 90, 5, 100, 1])]
    df = spark.createDataFrame(rows, "partition_id int, offset long, size long")
    assert [r.segment_id for r in folds.segment_rotation(df, 100).orderBy("offset").collect()] == [0, 0, 1, 2, 2, 3, 3, 4]


def test_compaction_by_consumers(spark):
    segs = spark.createDataFrame([(p, k, 100 * k, 100 * k + 99, 1, 1, 1, 10) for p in range(4) for k in range(3)], "partition_id int, segment_id long, first_offset long, last_offset long, created_ts long, newest_ts long, last_ts long, size long")
    marks = spark.createDataFrame([(p, 299) for p in range(4)], "partition_id int, hwm long")
    consumed = spark.createDataFrame([("a", 0, 250), ("b", 0, 150), ("a", 1, 0), ("b", 1, 250), ("a", 2, 299)], "group_id string, partition_id int, committed long")
    gone = lifecycle.compacted_by_consumers(segs, consumed, marks)
    assert [(r.partition_id, r.segment_id) for r in gone.collect()] == [(0, 0)]
    log = spark.createDataFrame([(0, 5), (0, 99), (0, 100), (1, 5)], "partition_id int, offset long")
    assert sorted((r.partition_id, r.offset) for r in lifecycle.without_segments(log, gone).collect()) == [(0, 100), (1, 5)]
    some = segs.where("partition_id = 0 and segment_id <> 1 or partition_id = 1 and segment_id < 2")
    log = spark.createDataFrame([(p, o) for p in range(3) for o in (0, 99, 100, 199, 200, 299)], "partition_id int, offset long")
    left = {(r.partition_id, r.offset) for r in lifecycle.without_segments(log, some).collect()}
    assert left == {(0, 100), (0, 199), (1, 200), (1, 299)} | {(2, o) for o in (0, 99, 100, 199, 200, 299)}


def test_stored_log_is_pruned(spark, sf_dir):
    """Scans of the stored log read one partition's files and push offset and time bounds to the row groups; the log is written once."""
    log = L.event_log(spark, sf_dir)
    assert set(log.inputFiles()) == set(L.event_log(spark, sf_dir).inputFiles())
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found = plan(L.point(log, 1, 17).select("message_id"))
    assert "PartitionFilters: [isnotnull(partition_id" in found and "(partition_id" in found and "EqualTo(offset,17)" in found and "Exchange" not in found
    found = plan(L.time_range(log, 10, 20, 3).select("offset"))
    assert "GreaterThanOrEqual(schedule_ts,10)" in found and "LessThanOrEqual(schedule_ts,20)" in found and "payload" not in found
    fresh = L.assign_offsets(L.from_events(spark, sf_dir))
    keep = lambda df: sorted((r.message_id, r.partition_id, r.offset) for r in df.collect())
    assert keep(log) == keep(fresh)


def test_bloom_sizes_and_positions(spark):
    assert bloom.sizing(1, 0.5) == (1024, 5) and bloom.sizing(1000, 0.01) == (10048, 7) and bloom.sizing(1000, 0.0001) == (15040, 7)

    def fnv(data, h=14695981039346656037):
        for byte in data:
            h = (h ^ byte) * 1099511628211 % 2**64
        return h

    salted = (14695981039346656037 ^ 0xABCDEF) * 1099511628211 % 2**64
    keys = ["", "a", "schlüssel", "x" * 40]
    got = [r.at for r in spark.createDataFrame([(k,) for k in keys], "k string").select(bloom.positions(F.col("k"), 10048, 7).alias("at")).collect()]
    assert got == [[(fnv(k.encode()) + i * fnv(k.encode(), salted)) % 2**64 % 10048 for i in range(7)] for k in keys]


def test_timers_over_several_batches(spark, tmp_path):
    """Late rows fire at once, cancels stop what is not due, an epoch run twice counts once, and the rest stays pending."""
    wheel = jobs.Timers(spark, str(tmp_path)).start()
    make = lambda rows: spark.createDataFrame(rows, wheel.ROW)
    first = make([("a", 50, 10, "set"), ("b", 15, 12, "set"), ("c", 90, 20, "set"), ("d", 500, 20, "set")])
    wheel.epoch(first, 0)
    assert {r.id for r in wheel.fired().collect()} == {"b"}
    wheel.epoch(make([("late", 3, 2, "set"), ("c", None, 60, "cancel"), ("a", None, 60, "cancel"), ("e", 70, 60, "set")]), 1)
    wheel.epoch(make([("late", 3, 2, "set"), ("c", None, 60, "cancel"), ("a", None, 60, "cancel"), ("e", 70, 60, "set")]), 1)
    # The cancel of a came after it was due.
    assert sorted(r.id for r in wheel.fired().collect()) == ["a", "b", "late"]
    wheel.epoch(make([("f", 1000, 100, "set")]), 2)
    assert sorted(r.id for r in wheel.fired().collect()) == ["a", "b", "e", "late"]
    assert sorted(r.id for r in wheel.pending().collect()) == ["d", "f"]


def test_audit_policy_snapshots(spark, tmp_path):
    """Side tables that have no query of their own: written, read, and filtered as their rules say."""
    audit = spark.createDataFrame([("2024-01-01", "publish", "u", "t", "ok", None, None, "r1")], S.AUDIT)
    files.write_audit(audit, f"{tmp_path}/audit")
    assert files.read_audit(spark, f"{tmp_path}/audit").first().request_id == "r1"
    (tmp_path / "policy.json").write_text('{"subject": "u", "grants": [{"topic": "*", "actions": ["publish"]}, {"topic": "t", "actions": ["read"]}]}\n')
    assert sorted((r.topic, r.actions) for r in files.read_policy(spark, f"{tmp_path}/policy.json").collect()) == [("*", ["publish"]), ("t", ["read"])]
    log = spark.createDataFrame([(0, 4), (0, 9), (1, 2)], "partition_id int, offset long")
    snaps = files.snapshot(log, spark.createDataFrame([("g", 0, 3)], "group_id string, partition_id int, committed long"))
    snaps.unionByName(snaps.withColumn("version", F.lit(9))).write.json(f"{tmp_path}/snaps")
    got = {r.partition_id: (r.high_watermark, r.group_offsets) for r in files.read_snapshots(spark, f"{tmp_path}/snaps").collect()}
    assert got == {0: (9, {"g": 3}), 1: (2, None)}
    tx = spark.createDataFrame([("t1", "committed", [0], 1, 2)], S.TX_RECORD)
    tx.write.json(f"{tmp_path}/tx")
    assert files.read_transactions(spark, f"{tmp_path}/tx").first().status == "committed"
    usage = files.disk_usage(spark, f"{tmp_path}/tx").first()
    assert usage.files >= 1 and usage.bytes > 0
    names = spark.createDataFrame([("/d/0a.log",), ("/d/raft/1.log",), ("/d/snapshots/2.wal",), ("/d/x.txt",)], "path string")
    assert [r.path for r in files.wal_files(names).collect()] == ["/d/0a.log"]


def test_webhook_and_fan_out(spark):
    """A feed goes to every sink; a receiver that refuses fails the batch."""
    import http.server
    import threading

    seen = []

    class Receiver(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(200 if self.path == "/ok" else 500)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Receiver)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    rows = spark.createDataFrame([('{"n": 1}',), ('{"n": 2}',)], "value string").coalesce(1)
    taken = []
    files.fan_out_sinks(files.webhook(f"{base}/ok"), lambda batch, epoch: taken.append((epoch, batch.count())))(rows, 4)
    assert seen == [[{"n": 1}, {"n": 2}]] and taken == [(4, 2)]
    with pytest.raises(Exception, match="did not take|Job aborted|refus"):
        files.webhook(f"{base}/no", attempts=1)(rows, 5)
    server.shutdown()


def test_avro_payloads():
    """Records of every type, encoded by hand; what ends early or has no such branch doesn't fit."""
    import struct

    from timelog.functions import binary

    schema = {"type": "record", "name": "R", "namespace": "n", "fields": [
        {"name": "i", "type": "int"}, {"name": "s", "type": ["null", "string"]}, {"name": "d", "type": "double"}, {"name": "e", "type": {"type": "enum", "name": "E", "symbols": ["A", "B"]}},
        {"name": "a", "type": {"type": "array", "items": "long"}}, {"name": "m", "type": {"type": "map", "values": "boolean"}}, {"name": "f", "type": {"type": "fixed", "name": "F", "size": 2}}, {"name": "next", "type": ["null", "n.R"]},
    ]}
    inner = b"\x03" + b"\x00" + struct.pack("<d", 1.5) + b"\x02" + b"\x00" + b"\x00" + b"xy" + b"\x00"
    data = b"\x54" + b"\x02\x04hi" + struct.pack("<d", -2.0) + b"\x00" + b"\x03\x04\x02\x04\x00" + b"\x02\x02k\x01\x00" + b"zz" + b"\x02" + inner
    got = binary.avro_value(json.dumps(schema), data)
    assert got == {"i": 42, "s": "hi", "d": -2.0, "e": "A", "a": [1, 2], "m": {"k": True}, "f": b"zz", "next": {"i": -2, "s": None, "d": 1.5, "e": "B", "a": [], "m": {}, "f": b"xy", "next": None}}
    assert binary.avro_fits(json.dumps(schema), data + b"more") and not any(binary.avro_fits(json.dumps(schema), data[:n]) for n in range(len(data)))
    assert not binary.avro_fits(json.dumps(schema), b"\x54\x04" + data[2:]) and not binary.avro_fits("{", b"") and not binary.avro_fits('"long"', b"\x02")


def test_protobuf_payloads(spark):
    """Wire format of well-known types and of a described message; without a descriptor an unknown type takes nothing."""
    from timelog.functions.binary import protobuf_fits

    field = lambda n, data: bytes([n << 3 | 2, len(data)]) + data
    described = lambda name, number, kind, of=b"": field(2, field(1, name) + bytes([3 << 3, number, 4 << 3, 1, 5 << 3, kind]) + (field(6, of) if of else b""))
    message = field(1, b"Order") + described(b"id", 1, 3) + described(b"note", 2, 9) + described(b"child", 3, 11, b".shop.Order") + described(b"counts", 4, 5)
    descriptor = field(1, b"f.proto") + field(2, b"shop") + field(4, message)
    good = b"\x08\x96\x01" + field(2, "\u00fc".encode()) + field(3, b"\x08\x01") + field(4, b"\x01\x96\x01")
    assert protobuf_fits("shop.Order", good, descriptor) and protobuf_fits("shop.Order", b"", descriptor) and protobuf_fits("shop.Order", field(9, b"\xff"), descriptor)
    assert not protobuf_fits("shop.Order", good[:-1], descriptor) and not protobuf_fits("shop.Order", field(2, b"\xff"), descriptor) and not protobuf_fits("shop.Order", field(3, field(2, b"\xff")), descriptor)
    assert not protobuf_fits("shop.Order", good) and not protobuf_fits("shop.Other", good, descriptor)
    assert protobuf_fits("google.protobuf.Timestamp", b"\x08\x01\x10\x02") and not protobuf_fits("google.protobuf.Timestamp", b"\x08")
    entry = field(1, b"k") + field(2, field(3, b"text"))
    assert protobuf_fits("google.protobuf.Struct", field(1, entry)) and not protobuf_fits("google.protobuf.Struct", field(1, field(1, b"\xff")))
    rows = spark.createDataFrame([("a", good), ("a", b"\x08"), ("b", b"{"), ("c", b"x")], "topic string, payload binary")
    registry = spark.createDataFrame([("a", 1, "protobuf", "shop.Order", descriptor), ("b", 1, "json", "{}", None)], "topic string, version int, type string, definition string, descriptor binary")
    assert sorted((r.topic, r.schema_ok) for r in schemas.validated(rows, registry).collect()) == [("a", False), ("a", True), ("b", False), ("c", True)]


def test_backoff_jitter(spark):
    got = spark.range(3).select(X.client_backoff(F.col("id"), jitter=0.2, u=F.lit(0.0)).alias("low"), X.client_backoff(F.col("id"), jitter=0.2).alias("any")).collect()
    assert [r.low for r in got] == [80, 160, 320] and all(100 * 2**n * 0.8 - 1 <= r.any <= 100 * 2**n * 1.2 for n, r in enumerate(got))


def test_administrators(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "subject string")
    subjects = spark.createDataFrame([("a", True), ("b", False)], "subject string, admin boolean")
    assert [r.subject for r in publish.administrators(rows, subjects).collect()] == ["a"]
    assert publish.administrators(rows, None).count() == 0 and publish.administrators(rows, subjects.limit(0)).count() == 3
