import pytest

from timelog.api import Store

KIND = "arrival long, message_id string, schedule_ts long, payload binary, topic string, meta map<string,string>"


def batch(spark, rows):
    return spark.createDataFrame([(n, i, ts, b'{"k": 1}', topic, {"partition_key": key}) for n, i, ts, topic, key in rows], KIND)


def test_publish_replay_ack(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), partitions=2)
    assert store.log().count() == 0 and store.register_schema("t", "json", '{"type":"object","properties":{"k":{"type":"integer"}}}') == 1
    with pytest.raises(ValueError):
        store.register_schema("t", "avro", "{}")
    one = store.publish_batch(batch(spark, [(1, "a", 100, "t", "x"), (2, "a", 100, "t", "x"), (3, "", 5, "t", "x"), (4, "b", 300, "t", "x")]), now=1).first()
    assert (one.published, one.duplicates, one.errors, one.min_offset, one.max_offset) == (2, 1, 1, 0, 1)
    two = store.publish_batch(batch(spark, [(5, "b", 1, "t", "x"), (6, "c", 200, "t", "x")]), now=2).first()
    assert (two.published, two.duplicates, two.min_offset) == (1, 1, 2)
    part = store.log().first().partition_id
    assert [r.message_id for r in store.replay(part, start_ts=100, end_ts=200).orderBy("seq").collect()] == ["a", "c"]
    assert [r.due_ms for r in store.replay(part, count=2, speed=2).orderBy("seq").collect()] == [0, 5]
    assert store.replay(part, start_ts=1, now=250).count() == 2
    with pytest.raises(ValueError):
        store.replay(-1)
    acks = spark.createDataFrame([("g", part, 1, "c1", 1), ("g", part, 1, "c1", 2), ("g", part, 0, "c2", 3), ("g", part, 2, "c3", 4)], store.offsets().drop("batch").schema)
    assert sorted(r.commit_id for r in store.ack(acks).collect()) == ["c1", "c3"]
    assert store.ack(acks).count() == 0
    lag = store.lag(spark.createDataFrame([("g", part), ("h", part)], "group_id string, partition_id int"))
    assert {r.group_id: (r.lag, r.backlog) for r in lag.collect()} == {"g": (0, 1), "h": (3, 3)}
    subs = spark.createDataFrame([("g", part, "m0"), ("g", part, "m1")], "group_id string, partition_id int, member_id string")
    assert sorted(r.delivery_id for r in store.subscribe(subs, now=250).collect()) == [f"g:{part}:m0-0", f"g:{part}:m0-2"]
    info = {r.partition_id: r.next_offset for r in store.partitions_info().collect()}
    assert info == {part: 3, 1 - part: 0}


def test_retention_and_split(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), partitions=1, segment_rows=2)
    store.publish_batch(batch(spark, [(n, f"m{n}", 100 * n, "t", "k") for n in range(1, 8)]), now=1)
    assert store.segments().count() == 4
    plan = store.retention_plan(now=1000, max_age_ms=700)
    assert [r.segment_id for r in plan.collect()] == [0]
    assert sorted(r.segment_id for r in store.retention_plan(now=1000, max_age_ms=700, max_bytes=24).collect()) == [0, 1]
    store.without(plan, str(tmp_path / "slim"))
    assert Store(spark, str(tmp_path / "slim")).log().count() == 5
    # Nobody has consumed anything: retention takes two segments and compaction none.
    assert store.maintain(str(tmp_path / "kept"), now=1000, max_age_ms=700, max_bytes=24) == {"expired": 2, "compacted": 0}
    assert sorted(r.offset for r in Store(spark, str(tmp_path / "kept")).log().collect()) == [4, 5, 6]
    store.split(0, 4, "", 5)
    assert [(r.message_id, r.offset) for r in store.log().where("partition_id = 5").orderBy("offset").collect()] == [("m5", 0), ("m6", 1), ("m7", 2)]
    assert store.log().count() == 10
