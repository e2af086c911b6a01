"""Operators whose state depends on their own earlier decisions, folded per key over ordered rows.

No window expression gives these exactly. Rows of a key are read in order in
Arrow batches, never held together: keys are hash-dealt, sorted inside
partitions, and a task keeps one key's small state at a time. Only the columns
that a fold reads travel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], dict], step: Callable[[dict, dict], dict], result: str) -> DataFrame:
    """Adds the columns `result` (a DDL string), which step(state, row) returns; the state starts anew with each key."""
    names = rows.columns
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), result])
    added = [x.split()[0] for x in result.split(", ")]
    types = [{"boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in result.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != current:
                    current, state = key, start()
                got = step(state, row)
                out.append([got[c] for c in added])
            cols = [pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*names, *added])

    # Dealt by a hash of its own: if `rows` came from a join on the keys, Spark would take a repartition by the keys themselves for
    # done, and adaptive execution, which sees no need of mapInArrow, could then split a key over tasks (local reads, skewed joins).
    return rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).mapInArrow(run, kinds)


def token_bucket(requests: DataFrame, keys: list[str], capacity: int, rate: int) -> DataFrame:
    """Adds allowed. Whole tokens are refilled; the refill time moves only if a token was added. Columns: ts (ms), n."""

    def start():
        return {"tokens": capacity, "last": None}

    def step(s, r):
        s["last"] = r["ts"] if s["last"] is None else s["last"]
        refill = max(0, r["ts"] - s["last"]) * rate // 1000
        if refill > 0:
            s["tokens"], s["last"] = min(capacity, s["tokens"] + refill), r["ts"]
        ok = s["tokens"] >= r["n"]
        s["tokens"] -= r["n"] if ok else 0
        return {"allowed": ok, "tokens": s["tokens"]}

    return fold(requests, keys, ["ts", "arrival"], start, step, "allowed boolean, tokens long")


def smooth_bucket(requests: DataFrame, keys: list[str], capacity: float, rate: float) -> DataFrame:
    """As token_bucket, with fractions of tokens."""

    def step(s, r):
        s["last"] = r["ts"] if s["last"] is None else s["last"]
        s["tokens"] = min(capacity, s["tokens"] + (r["ts"] - s["last"]) / 1000 * rate)
        s["last"] = r["ts"]
        ok = s["tokens"] >= r["n"]
        s["tokens"] -= r["n"] if ok else 0
        return {"allowed": ok}

    return fold(requests, keys, ["ts", "arrival"], lambda: {"tokens": capacity, "last": None}, step, "allowed boolean")


def client_bucket(requests: DataFrame, capacity: float, rate: float) -> DataFrame:
    """Adds allowed, one token a request. Tokens count in millionths; a refused request moves the clock and forgoes what had been refilled. Columns: client, ts (ms), arrival."""
    unit = 1_000_000
    full = int(capacity * unit)

    def step(s, r):
        elapsed = 0 if s["last"] is None else max(0, r["ts"] - s["last"])
        free = min(full, s["micro"] + int(elapsed * unit * (rate / 1000)))
        s["last"] = r["ts"]
        ok = free >= unit
        if ok:
            s["micro"] = free - unit
        return {"allowed": ok}

    return fold(requests, ["client"], ["ts", "arrival"], lambda: {"micro": full, "last": None}, step, "allowed boolean")


def region_flushes(rows: DataFrame, size: int = 100, every_ms: int = 100, cap: int = 100_000) -> DataFrame:
    """Adds sent, dropped and pending of each region's buffer after each event.

    The buffer goes out when it holds `size` events, and when an interval of
    `every_ms` has begun since the event before. If the region can't be reached
    (ok is false), events go back to its front, and the oldest beyond `cap` are
    dropped. Columns: region, ts, arrival, ok.
    """

    def step(s, r):
        sent = dropped = 0
        slot = r["ts"] // every_ms
        for due in (s["slot"] is not None and slot > s["slot"] and s["held"] > 0, None):
            if due is None:
                s["held"] += 1
                due = s["held"] >= size
            if due and r["ok"]:
                sent, s["held"] = sent + s["held"], 0
            elif due:
                dropped, s["held"] = dropped + max(0, s["held"] - cap), min(s["held"], cap)
        s["slot"] = slot
        return {"sent": sent, "dropped": dropped, "pending": s["held"]}

    return fold(rows, ["region"], ["ts", "arrival"], lambda: {"slot": None, "held": 0}, step, "sent long, dropped long, pending long")


def tenant_reserve(requests: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds reserved and reason: rate, then events in flight, then bytes; a later refusal gives back what earlier checks took.

    Requests: tenant, ts, arrival, n, bytes. Limits: max_events_per_second,
    max_in_flight, max_storage_bytes; 0 is none. Tenants without limits pass.
    """
    rows = requests.join(limits, "tenant", "left")

    def step(s, r):
        if r["max_events_per_second"] is None or r["n"] <= 0:
            return {"reserved": True, "reason": None}
        cap = r["max_events_per_second"]
        if cap > 0:
            s["tokens"] = cap if s["last"] is None else min(cap, s["tokens"] + (r["ts"] - s["last"]) / 1000 * cap)
            s["last"] = r["ts"]
            if s["tokens"] < r["n"]:
                return {"reserved": False, "reason": "rate"}
        if 0 < r["max_in_flight"] < s["flight"] + r["n"]:
            return {"reserved": False, "reason": "in flight"}
        if 0 < r["max_storage_bytes"] < s["bytes"] + r["bytes"]:
            return {"reserved": False, "reason": "storage"}
        s["tokens"] -= r["n"] if cap > 0 else 0
        s["flight"] += r["n"]
        s["bytes"] += r["bytes"]
        return {"reserved": True, "reason": None}

    return fold(rows, ["tenant"], ["ts", "arrival"], lambda: {"tokens": 0, "last": None, "flight": 0, "bytes": 0}, step, "reserved boolean, reason string")


def dedup_with_ttl(rows: DataFrame, ttl_ms: int) -> DataFrame:
    """Adds duplicate: the id's claim has not run out. A claim lasts ttl_ms from when it was made and is not renewed by duplicates."""

    def step(s, r):
        again = s["until"] is not None and r["ts"] < s["until"]
        if not again:
            s["until"] = r["ts"] + ttl_ms
        return {"duplicate": again}

    return fold(rows, ["partition_id", "message_id"], ["ts", "arrival"], lambda: {"until": None}, step, "duplicate boolean")


def circuit_breaker(outcomes: DataFrame, threshold: float = 0.5, min_attempts: int = 10, open_ms: int = 30_000) -> DataFrame:
    """Adds tried and state (closed, open, half-open) after each outcome of a subscription. Columns: subscription, ts, arrival, ok."""

    def start():
        return {"state": "closed", "good": 0, "bad": 0, "until": 0}

    def step(s, r):
        if s["state"] == "open":
            if r["ts"] < s["until"]:
                return {"tried": False, "state": "open"}
            s.update(state="half-open", good=0, bad=0)
        if r["ok"]:
            if s["state"] == "half-open":
                s.update(state="closed", good=0, bad=0)
            else:
                s["good"] += 1
        else:
            s["bad"] += s["state"] == "closed"
            total = s["good"] + s["bad"]
            if s["state"] == "half-open" or (total >= min_attempts and s["bad"] / total >= threshold):
                s.update(state="open", until=r["ts"] + open_ms)
        return {"tried": True, "state": s["state"]}

    return fold(outcomes, ["subscription"], ["ts", "arrival"], start, step, "tried boolean, state string")


def credit_dispatch(events: DataFrame, members: list[str], credits: int, ack_every: int) -> DataFrame:
    """Adds member: round robin over members that have credits; null if none has. Every `ack_every` events one round of credits comes back.

    Columns: group_id, partition_id, offset.
    """
    names = sorted(members)

    def start():
        return {"cursor": 0, "left": [credits] * len(names), "seen": 0}

    def step(s, r):
        s["seen"] += 1
        if s["seen"] % ack_every == 0:
            s["left"] = [min(credits, c + 1) for c in s["left"]]
        for k in range(len(names)):
            at = (s["cursor"] + k) % len(names)
            if s["left"][at] > 0:
                s["left"][at] -= 1
                s["cursor"] = at + 1
                return {"member": names[at]}
        return {"member": None}

    return fold(events, ["group_id", "partition_id"], ["offset"], start, step, "member string")


def segment_rotation(log: DataFrame, limit: int) -> DataFrame:
    """Adds segment_id: a segment that has reached `limit` bytes ends. Columns: partition_id, offset, size."""

    def step(s, r):
        if s["bytes"] >= limit:
            s["id"], s["bytes"] = s["id"] + 1, 0
        s["bytes"] += r["size"]
        return {"segment_id": s["id"]}

    return fold(log, ["partition_id"], ["offset"], lambda: {"id": 0, "bytes": 0}, step, "segment_id long")


def delivery_lifecycle(acks: DataFrame, max_attempts: int = 5, timeout_ms: int = 30_000, base_ms: int = 1_000) -> DataFrame:
    """Adds outcome, attempts and ended of each delivery attempt series.

    Rows are the acks of a delivery in order (ok, delay_ms; no ack in time if
    delay_ms is null or above the timeout). Columns: delivery_id, seq, sent_at.
    """

    def step(s, r):
        if s["outcome"] in ("acked", "dead letter"):
            return {"outcome": "ignored", "attempts": s["n"], "ended": s["at"]}
        s["n"] += 1
        s["at"] = r["sent_at"] if s["at"] is None else s["at"]
        late = r["delay_ms"] is None or r["delay_ms"] > timeout_ms
        s["at"] += timeout_ms if late else r["delay_ms"]
        if r["ok"] and not late:
            s["outcome"] = "acked"
        elif s["n"] >= max_attempts:
            s["outcome"] = "dead letter"
        else:
            s["outcome"] = "retry"
            s["at"] += s["n"] * base_ms
        return {"outcome": s["outcome"], "attempts": s["n"], "ended": s["at"]}

    return fold(acks, ["delivery_id"], ["seq"], lambda: {"n": 0, "at": None, "outcome": None}, step, "outcome string, attempts int, ended long")


def final_outcomes(folded: DataFrame) -> DataFrame:
    done = folded.where("outcome <> 'ignored'")
    return done.groupBy("delivery_id").agg(F.max_by(F.struct("outcome", "attempts", "ended"), "seq").alias("x")).select("delivery_id", "x.*")
