"""Consumer groups: lag, committed offsets, assignment and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = "group_id string, topic string, partitions array<int>, committed_offsets map<string,long>, member_offsets map<string,long>"


def high_watermarks(log: DataFrame, partitions: DataFrame | None = None) -> DataFrame:
    """hwm, last_offset, next_offset by partition. With a table of all partitions, empty ones are there too: 0, -1, 0."""
    out = log.groupBy("partition_id").agg(F.max("offset").alias("last_offset"))
    if partitions is not None:
        out = partitions.select("partition_id").join(out, "partition_id", "left")
    last = F.coalesce("last_offset", F.lit(-1))
    return out.select("partition_id", F.coalesce("last_offset", F.lit(0)).cast("long").alias("hwm"), last.cast("long").alias("last_offset"), (last + 1).cast("long").alias("next_offset"))


def committed_offsets(stored: DataFrame, pending: DataFrame, wanted: DataFrame) -> DataFrame:
    """A pending commit overrides a stored one; -1 without either."""
    keys = ["group_id", "partition_id"]
    p = pending.groupBy(*keys).agg(F.max_by("committed", "seq").alias("p"))
    s = stored.select(*keys, F.col("committed").alias("s"))
    return wanted.join(p, keys, "left").join(s, keys, "left").select(*keys, F.coalesce("p", "s", F.lit(-1)).cast("long").alias("committed"))


def lag(committed: DataFrame, marks: DataFrame) -> DataFrame:
    """lag = high watermark - committed, not below 0; backlog = events not consumed yet. -1 marks a missing partition."""
    out = committed.join(marks.select("partition_id", "hwm", "next_offset"), "partition_id", "left")
    return out.select(
        "group_id", "partition_id", "committed",
        F.coalesce("hwm", F.lit(-1)).alias("hwm"),
        F.when(F.col("hwm").isNull(), -1).otherwise(F.greatest(F.col("hwm") - F.col("committed"), F.lit(0))).cast("long").alias("lag"),
        F.when(F.col("hwm").isNull(), -1).otherwise(F.greatest(F.col("next_offset") - F.greatest("committed", F.lit(0)), F.lit(0))).cast("long").alias("backlog"),
    )


def min_consumed(committed: DataFrame, marks: DataFrame) -> DataFrame:
    """What every group of a partition has consumed; a group without a commit counts as 0. Partitions without groups are left out."""
    out = committed.groupBy("partition_id").agg(F.min(F.when(F.col("committed") == -1, 0).otherwise(F.coalesce("committed", F.lit(0)))).alias("c"))
    return out.join(marks.select("partition_id", "hwm"), "partition_id").select("partition_id", F.least("hwm", "c").cast("long").alias("min_consumed"))


def upsert_offsets(commits: DataFrame) -> DataFrame:
    """The last commit, by seq, of each group and partition."""
    return commits.groupBy("group_id", "partition_id").agg(F.max_by("committed", "seq").alias("committed"))


def rebalance(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Round robin of each group's partitions over its members in order of id."""
    sorted_members = members.groupBy("group_id").agg(F.array_sort(F.collect_set("member_id")).alias("ms"))
    spread = groups.select("group_id", F.posexplode(F.array_sort("partitions")).alias("pos", "partition_id"))
    return spread.join(sorted_members, "group_id").select("group_id", "partition_id", F.element_at("ms", (F.col("pos") % F.size("ms") + 1).cast("int")).alias("member_id"))


def group_stats(groups: DataFrame, members: DataFrame) -> DataFrame:
    """One row: groups, groups with members, members."""
    n = members.groupBy("group_id").agg(F.count_distinct("member_id").alias("n"))
    return groups.join(n, "group_id", "left").agg(F.count("*").alias("groups"), F.count_if(F.coalesce("n", F.lit(0)) > 0).alias("active_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("members"))


def write_groups(groups: DataFrame, path: str) -> None:
    """Group metadata as JSON lines; maps that are empty are left out, as stores that write them do."""
    groups.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """Group metadata with empty maps in place of those that are left out; lines that are no JSON are skipped."""
    rows = spark.read.schema(f"{GROUP}, __bad string").option("columnNameOfCorruptRecord", "__bad").json(path)
    rows = rows.where("__bad is null and group_id is not null")
    none = F.create_map().cast("map<string,long>")
    return rows.select("group_id", "topic", "partitions", *(F.coalesce(c, none).alias(c) for c in ("committed_offsets", "member_offsets")))


def listing(groups: DataFrame) -> DataFrame:
    return groups.select("topic", "group_id").distinct().orderBy("topic", "group_id")
