"""Column functions of the log: hashing, routing, ids, time and back-off arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW32 = 0xFFFFFFFF
# Fixed values of FNV-1a, 64 bit: offset basis by 32-bit halves, and prime = 2**40 + 435.
FNV_BASIS_HIGH, FNV_BASIS_LOW, FNV_PRIME_LOW = 3421674724, 2216829733, 435
# Upper bounds of the latency histogram in microseconds; what is longer goes to one more bucket.
LATENCY_BOUNDS = (100, 250, 500, 1000, 2500, 5000, 10000, 25000, 50000, 100000, 250000, 500000, 1000000, 2500000, 5000000, 10000000)


def byte_values(data: Column) -> Column:
    """The bytes of a string or binary column as an array of integers; empty for an empty value."""
    latin = F.decode(data.cast("binary"), "ISO-8859-1")
    return F.transform(F.filter(F.split(latin, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))


def fnv1a64(data: Column, finish: Callable[[Column], Column] | None = None, start: tuple[int, int] = (FNV_BASIS_HIGH, FNV_BASIS_LOW)) -> Column:
    """struct(hi, lo): FNV-1a of the bytes as two unsigned 32-bit halves, so that nothing overflows a long.

    `finish` maps the struct inside the fold, so that the bytes are folded once.
    """
    start = F.struct(F.lit(start[0]).cast("long").alias("hi"), F.lit(start[1]).cast("long").alias("lo"))

    def step(state: Column, byte: Column) -> Column:
        x = state["lo"].bitwiseXOR(byte)
        low = x * FNV_PRIME_LOW
        # hash * (2**40 + 435): the high half gets hi * 435, the carry of lo * 435, and lo shifted by 40 - 32 bits.
        high = state["hi"] * FNV_PRIME_LOW + F.shiftrightunsigned(low, 32) + F.shiftleft(x, 8)
        return F.struct(high.bitwiseAND(F.lit(_LOW32)).alias("hi"), low.bitwiseAND(F.lit(_LOW32)).alias("lo"))

    return F.aggregate(byte_values(data), start, step, finish) if finish else F.aggregate(byte_values(data), start, step)


def fnv_mod(data: Column, n: int) -> Column:
    return fnv1a64(data, lambda h: ((h["hi"] % n) * ((1 << 32) % n) + h["lo"] % n) % n)


def fnv_hex(data: Column) -> Column:
    return fnv1a64(data, lambda h: F.lower(F.concat(F.lpad(F.hex(h["hi"]), 8, "0"), F.lpad(F.hex(h["lo"]), 8, "0"))))


def partition_of(key: Column, n: int) -> Column:
    """Unsigned FNV-1a of the key modulo n; 0 if n is not positive. Never null, so that no plan hashes once more to test for that."""
    return F.coalesce((fnv_mod(key, n) if n > 0 else F.lit(0)).cast("int"), F.lit(0))


def partition_key(meta: Column, message_id: Column) -> Column:
    return F.coalesce(F.nullif(meta["partition_key"], F.lit("")), message_id)


def checksum(payload: Column) -> Column:
    return F.crc32(payload)


def batch_checksum(rows: Column) -> Column:
    """CRC32 over an array of structs (offset, term, checksum, payload): of each, 8, 8 and 4 bytes, the highest first, then the payload. A checksum of 0 or null stands for the payload's own."""

    def part(r: Column) -> Column:
        crc = F.when(F.coalesce(r["checksum"], F.lit(0)) == 0, checksum(r["payload"])).otherwise(r["checksum"])
        head = F.concat(F.lpad(F.hex(r["offset"]), 16, "0"), F.lpad(F.hex(r["term"]), 16, "0"), F.lpad(F.hex(crc), 8, "0"))
        return F.concat(F.unhex(head), r["payload"])

    return F.crc32(F.aggregate(rows, F.lit(b""), lambda all_, r: F.concat(all_, part(r))))


def sha1_hex(data: Column) -> Column:
    return F.sha1(data.cast("binary"))


def ring_position(key: Column) -> Column:
    """First eight bytes of SHA-256 as an unsigned number; its fixed-width hex form sorts alike and needs no decimals."""
    return F.substring(F.sha2(key.cast("binary"), 256), 1, 16)


def ring_number(position: Column) -> Column:
    return F.conv(position, 16, 10).cast("decimal(20,0)")


def auto_message_id(topic: Column, key: Column, schedule_ts: Column, payload: Column) -> Column:
    zero = F.lit(b"\x00")
    data = F.concat(topic.cast("binary"), zero, key.cast("binary"), zero, schedule_ts.cast("string").cast("binary"), zero, payload.cast("binary"))
    return F.concat(F.lit("auto-"), fnv_hex(data))


def delivery_id(subscription: Column, offset: Column, count: Column | None = None) -> Column:
    """subscription-offset, or subscription-batch-offset-count for batches of several events."""
    one = F.concat_ws("-", subscription, offset.cast("string"))
    if count is None:
        return one
    return F.when(count == 1, one).otherwise(F.concat_ws("-", subscription, F.lit("batch"), offset.cast("string"), count.cast("string")))


def subscription_id(group: Column, partition: Column, member: Column) -> Column:
    return F.concat_ws(":", group, partition.cast("string"), member)


def subscription_of(delivery: Column) -> Column:
    batch = F.regexp_extract(delivery, r"^(.+)-batch-(-?\d+)-(-?\d+)$", 1)
    return F.when(batch != "", batch).otherwise(F.regexp_extract(delivery, r"^(.+)-(-?\d+)$", 1))


def group_and_partition(delivery: Column) -> tuple[Column, Column]:
    """Split at the first two colons; null without them."""
    parts = F.split(delivery, ":", 3)
    whole = F.size(parts) == 3
    return F.when(whole, parts[0]), F.when(whole, F.get(parts, 1).try_cast("int"))


def created_nanos(created: Column) -> Column:
    """Above 1e16 it is nanoseconds already, else milliseconds."""
    return F.when(created > 10**16, created).otherwise(created * 1_000_000)


def resolve_schedule(schedule_ts: Column, at: Column) -> Column:
    return F.when(schedule_ts > 0, schedule_ts).otherwise(F.unix_millis(at))


def latency_bucket(us: Column) -> Column:
    bucket = F.lit(len(LATENCY_BOUNDS))
    for i in reversed(range(len(LATENCY_BOUNDS))):
        bucket = F.when(us <= LATENCY_BOUNDS[i], i).otherwise(bucket)
    return bucket.cast("int")


def latency_bound(bucket: Column) -> Column:
    """The upper bound of a bucket; the last is reported as 10 s."""
    bounds = F.array(*(F.lit(b).cast("long") for b in (*LATENCY_BOUNDS, LATENCY_BOUNDS[-1])))
    return F.get(bounds, bucket)


def wheel_level(delay: Column, tick: int = 10, size: int = 512, levels: int = 5) -> Column:
    """The lowest timing-wheel level that a delay fits in."""
    level = F.lit(levels)
    for i in reversed(range(levels)):
        level = F.when(F.floor(delay / (tick * size**i)) < size, i).otherwise(level)
    return level.cast("int")


def wheel_slot(delay: Column, level: Column, tick: int = 10, size: int = 512, levels: int = 5) -> Column:
    slot = F.lit(None).cast("long")
    for i in range(levels):
        slot = F.when(level == i, F.floor(delay / (tick * size**i)) % size).otherwise(slot)
    return slot.cast("int")


def delivery_backoff(attempt: Column, base_ms: int = 1000) -> Column:
    return attempt.cast("long") * base_ms


def client_backoff(attempt: Column, least_ms: int = 100, most_ms: int = 10_000, jitter: float = 0.0, u: Column | None = None) -> Column:
    """Doubles up to a cap; with `jitter`, moved by up to that share either way, as u (random in [0, 1) if not given) says."""
    wait = F.least(F.lit(float(least_ms)) * F.pow(F.lit(2.0), attempt), F.lit(float(most_ms)))
    return (wait * (1 + jitter * (2 * (F.rand() if u is None else u) - 1)) if jitter else wait).cast("long")


def recovery_backoff(attempt: Column) -> Column:
    return F.when(attempt >= 9, 300).otherwise(F.least(F.pow(F.lit(2.0), attempt), F.lit(300.0))).cast("long")


def adapted_interval(interval: Column, hydrated: Column, scan_ms: Column, growth: Column, least: int = 1000, most: int = 60_000) -> Column:
    """The next scan interval in milliseconds: shorter with load, long scans and a growing cold store."""
    ladder = (10_000, 0.4), (5_000, 0.5), (1_000, 0.6), (100, 0.8)
    factor = F.when(hydrated == 0, 1.5).otherwise(1.1)
    for bound, f in reversed(ladder):
        factor = F.when(hydrated > bound, f).otherwise(factor)
    step = F.floor(interval * factor)
    step = F.when(scan_ms > F.floor(step / 2), F.floor(step * 0.7)).otherwise(step)
    step = F.when(growth > 1000, F.floor(step * 0.5)).otherwise(step)
    return F.greatest(F.lit(least), F.least(F.lit(most), step)).cast("long")


def shard_of(delivery: Column, shards: int = 32) -> Column:
    """31-polynomial of the bytes in 32 bits, modulo `shards`."""
    return (F.aggregate(byte_values(delivery), F.lit(0).cast("long"), lambda h, b: (h * 31 + b) % (1 << 32)) % shards).cast("int")


def schema_hash(definition: Column, descriptor: Column) -> Column:
    return fnv_hex(F.concat(definition.cast("binary"), F.coalesce(descriptor.cast("binary"), F.lit(b""))))


def metric_label(label: Column) -> Column:
    """Labels end after 256 bytes."""
    return F.decode(F.substring(label.cast("binary"), 1, 256), "UTF-8")


def offset_of_file(name: Column) -> Column:
    """The offset that a segment's file name gives in hexadecimal."""
    return F.conv(F.regexp_extract(name, r"([0-9a-fA-F]+)\.[^.]*$", 1), 16, 10).try_cast("long")


def next_offset(batch: Column) -> Column:
    return F.element_at(batch, -1)["offset"] + 1


def random_delivery_id() -> Column:
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))


def clock_skewed(remote: Column, local: Column, most_ms: int = 5000) -> Column:
    return F.abs(remote - local) > most_ms


def member_state(silent_ms: Column, heartbeat_ms: int = 1000) -> Column:
    return F.when(silent_ms > 10 * heartbeat_ms, "dead").when(silent_ms > 5 * heartbeat_ms, "suspect").otherwise("alive")


def retryable(code: Column) -> Column:
    return code.isin("Unavailable", "DeadlineExceeded", "Aborted")


def key_in_bounds(key: Column, least: Column, most: Column) -> Column:
    """least <= key < most by bytes; an empty bound is none."""
    k, a, b = (c.cast("binary") for c in (key, least, most))
    return ((F.length(a) == 0) | (k >= a)) & ((F.length(b) == 0) | (k < b))


def client_supported(version: Column, least: int = 1, most: int = 1) -> Column:
    """A client's protocol version is in range; none counts as the lowest."""
    return F.coalesce(version, F.lit(least)).between(least, most)
