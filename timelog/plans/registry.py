"""All queries of the event-log operators by name, with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: 2024-01-15 00:00:00 UTC, the instant at which queries stand.
NOW = 1705276800000


def fnv_sql(key: str, n: int) -> str:
    return (
        "CAST(list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split("
        f"{key}, ''), lambda x: ascii(x)::UHUGEINT)), lambda h, c: (xor(h, c) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) % {n} AS INTEGER)"
    )


#: Common tables of the oracles: `ev`, `routed` and `log` as timelog.sources.log builds them; `parts` and `groups` as the plans do.
LOG = f"""
ev AS (SELECT event_id, event_id AS arrival, epoch_us(ts) // 1000 AS schedule_ts, user_id, event_type AS topic, value, props,
              CAST(floor(value * 1000) AS BIGINT) AS latency_us, 'evt-' || event_id AS message_id FROM events),
routed AS (SELECT *, {fnv_sql("CAST(user_id AS VARCHAR)", 8)} AS partition_id FROM ev),
log AS (SELECT *, row_number() OVER (PARTITION BY partition_id ORDER BY arrival) - 1 AS "offset" FROM routed),
marks AS (SELECT partition_id, max("offset") AS hwm, max("offset") + 1 AS next_offset FROM log GROUP BY partition_id),
groups AS (SELECT 'g' || i AS group_id, i, partition_id, CAST(floor(hwm * (i + 1) / 4.0) AS BIGINT) AS committed FROM marks, range(3) t(i)),
segs AS (SELECT partition_id, "offset" // 100 AS segment_id, min("offset") AS first_offset, max("offset") AS last_offset,
                min(schedule_ts) AS created_ts, max(schedule_ts) AS newest_ts, CAST(sum(strlen(props)) AS BIGINT) AS size, count(*) AS events
         FROM log GROUP BY 1, 2)
"""


#: The table of CRC-32 by byte, and the checksum of a list of bytes.
CRC_TABLE = ", crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t)"


def crc_sql(data: str) -> str:
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {data}), lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256)))"


def bytes_sql(text: str) -> str:
    """The bytes of an ASCII text."""
    return f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"


def query(name: str, sql: str | None = None):
    """Register a query; `sql` goes on after the common tables: with more of them after a comma, or with the select."""

    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = f"WITH RECURSIVE {LOG}{sql}"
        return build

    return add


from timelog.plans import cluster, delivery, groups, lifecycle, publish, scans, slo, streams  # noqa: E402, F401
