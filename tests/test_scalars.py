import hashlib
import zlib

from pyspark.sql import functions as F

from timelog.functions import scalars as X

KEYS = ["", "a", "user-17", "schlüssel", "键", "x" * 130]


def fnv(data: bytes) -> int:
    h = 14695981039346656037
    for b in data:
        h = (h ^ b) * 1099511628211 % 2**64
    return h


def test_hashes(spark):
    rows = spark.createDataFrame([(k,) for k in KEYS], "k string")
    k = F.col("k")
    for r in rows.select("k", X.fnv_hex(k).alias("hex"), X.partition_of(k, 7).alias("p7"), X.partition_of(k, 16).alias("p16"), X.partition_of(k, 0).alias("p0"), X.checksum(k.cast("binary")).alias("crc"), X.ring_number(X.ring_position(k)).alias("ring"), X.shard_of(k).alias("shard")).collect():
        data = r["k"].encode()
        assert int(r["hex"], 16) == fnv(data)
        assert (r["p7"], r["p16"], r["p0"]) == (fnv(data) % 7, fnv(data) % 16, 0)
        assert r["crc"] == zlib.crc32(data)
        assert int(r["ring"]) == int.from_bytes(hashlib.sha256(data).digest()[:8], "big")
        h = 0
        for b in data:
            h = (h * 31 + b) % 2**32
        assert r["shard"] == h % 32


def test_delivery_ids(spark):
    rows = spark.createDataFrame([("g:3:m-1-17",), ("g:3:m-batch-5-9",), ("g:3:m-batch-x-2",), ("nothing",)], "d string")
    group, part = X.group_and_partition(F.col("d"))
    got = rows.select(X.subscription_of(F.col("d")), group, part).collect()
    assert [tuple(r) for r in got] == [("g:3:m-1", "g", 3), ("g:3:m", "g", 3), ("g:3:m-batch-x", "g", 3), ("", None, None)]


def test_time_arithmetic(spark):
    one = spark.range(1)
    got = one.select(
        X.created_nanos(F.lit(1705276800000)), X.created_nanos(F.lit(1705276800000000000)), X.latency_bucket(F.lit(100)), X.latency_bucket(F.lit(101)), X.latency_bucket(F.lit(10_000_001)),
        X.latency_bound(F.lit(16)), X.wheel_level(F.lit(5119)), X.wheel_level(F.lit(5120)), X.member_state(F.lit(5000)), X.member_state(F.lit(5001)), X.member_state(F.lit(10_001)),
        X.clock_skewed(F.lit(5000), F.lit(0)), X.offset_of_file(F.lit("/a/00ff.log")), F.length(X.metric_label(F.lit("m" * 300))),
    ).first()
    assert tuple(got) == (1705276800000 * 10**6, 1705276800000000000, 0, 1, 16, 10_000_000, 0, 1, "alive", "suspect", "dead", False, 255, 256)


def test_key_bounds(spark):
    rows = spark.createDataFrame([("apple", "", "banana"), ("banana", "", "banana"), ("banana", "banana", ""), ("", "a", ""), ("ä", "z", "")], "k string, a string, b string")
    assert [r[0] for r in rows.select(X.key_in_bounds(F.col("k"), F.col("a"), F.col("b"))).collect()] == [True, False, True, False, True]
