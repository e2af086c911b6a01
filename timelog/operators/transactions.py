"""Transactions as folds of marker rows, and what recovery does with each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A later status outranks an earlier one of the same transaction.
ORDER = {"begin": "pending", "prepare": "prepared", "committing": "committing", "commit": "committed", "abort": "aborted"}


def states(markers: DataFrame) -> DataFrame:
    """The state of each tx_id after its last marker, by seq."""
    last = markers.groupBy("tx_id").agg(F.max_by("action", "seq").alias("action"), F.min("ts").alias("created_ts"), F.max("ts").alias("updated_ts"), F.count("*").alias("markers"))
    status = F.create_map(*(F.lit(x) for pair in ORDER.items() for x in pair))
    return last.select("tx_id", status[F.col("action")].alias("status"), "created_ts", "updated_ts", "markers")


def recovery(found: DataFrame, now: int, timeout_ms: int) -> DataFrame:
    """abort pending ones past the timeout, commit what was prepared or half committed."""
    old = now - F.col("created_ts") > timeout_ms
    action = F.when((F.col("status") == "pending") & old, "abort").when(F.col("status").isin("prepared", "committing"), "commit").otherwise("none")
    return found.withColumn("recovery", action)


def visible(log: DataFrame, found: DataFrame) -> DataFrame:
    """Rows outside transactions or in committed ones."""
    done = found.where("status = 'committed'").select("tx_id")
    tx = F.col("meta")["tx_id"]
    keyed = log.withColumn("tx_id", tx)
    return keyed.where("tx_id is null").unionByName(keyed.join(done, "tx_id", "left_semi").select(keyed.columns)).drop("tx_id")
