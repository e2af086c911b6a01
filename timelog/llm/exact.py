"""Exact dedup by progressive refinement, in DataFrame expressions alone.

Texts are equal when they agree after all ASCII white space is deleted. Groups
are refined by normalised length, then by the hash of a prefix, then by a hash
of the whole. Normalising has read the whole text by then, so one scan makes a
narrow table of all three, and each round only hands on the rows that can still
be copies; no text is read again or shuffled to find them. Counts are partially
aggregated before each shuffle, so a group of copies of any size is one row of
each pre-aggregated table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelog.llm.common import SPACE, discard, stored, unnamed

PREFIX = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", "")


def _points(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit(""))).cast("long")


def _narrow(docs: DataFrame, id_col: str, text_col: str, sha: bool) -> DataFrame:
    """Stored (id, th, points, norm_len, prefix, digest) of every row; th: a hash of the text as it is; digest: SHA-256 of the normalised text if `sha`, else 128 bits of a faster hash."""
    norm = normalised(F.col(text_col))
    digest = F.sha2(norm, 256) if sha else F.concat(F.hex(F.xxhash64(norm)), F.lit("-"), F.hex(F.xxhash64(F.lit("again"), norm)))
    return stored(
        docs.select(
            F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), _points(F.col(text_col)).alias("points"), F.length(norm).alias("norm_len"), F.xxhash64(F.substring(norm, 1, PREFIX)).alias("prefix"), digest.alias("digest")
        )
    )


def _survivors(narrow: DataFrame) -> DataFrame:
    """Stored (id, th, points, digest, n): rows whose length and prefix others share, once for each id and text, n times in the input."""
    # Copies of a text are one row here, so no length is hot for the copies it has.
    pairs = narrow.groupBy("norm_len", "prefix").agg(F.count("*").alias("n"))
    lengths = pairs.groupBy("norm_len").agg(F.sum("n").alias("m")).where("m > 1").select("norm_len")
    prefixes = pairs.join(lengths, "norm_len", "left_semi").where("n > 1").select("norm_len", "prefix")
    full = narrow.join(prefixes, ["norm_len", "prefix"], "left_semi")
    return stored(full.groupBy("id", "th", "points", "digest").agg(F.count("*").alias("n")))


def _groups(full: DataFrame) -> DataFrame:
    """Stored digest, keep_id, keep_th, keep_points, group_size of each group of two or more equal texts.

    The row with the most code points, then the smallest id, is kept (a null id
    sorts last), of rows that agree in both the least hash of the text.
    """
    first = F.min(F.struct((-F.col("points")).alias("less"), F.col("id").isNull().alias("void"), F.col("id"), F.col("th")))
    found = full.groupBy("digest").agg(F.sum("n").alias("group_size"), first.alias("first")).where("group_size > 1")
    return stored(found.select("digest", F.col("first.id").alias("keep_id"), F.col("first.th").alias("keep_th"), (-F.col("first.less")).alias("keep_points"), "group_size"))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per group of two or more equal texts: digest, keep_id, keep_th, keep_points, group_size.

    Null counts as empty text. An empty table gives no groups.
    """
    narrow = _narrow(docs, id_col, text_col, sha=True)
    full = _survivors(narrow)
    groups = _groups(full)
    discard(narrow, full)
    return groups


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, text_sha256.

    Rows that agree in id and text too are one group like any other: one of
    them has kept = true. Columns other than id and text are not read, so
    their names cannot clash.
    """
    narrow = _narrow(docs, id_col, text_col, sha=True)
    full = _survivors(narrow)
    groups = _groups(full)
    discard(full)
    rows = narrow.groupBy("id", "points", "digest").agg(F.count("*").cast("int").alias("n"))
    out = rows.join(groups, "digest", "left").select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("nth"))
    mine = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))
    alone = F.col("group_size").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (mine & (F.col("nth") == 1))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows that exact_dedup drops; columns as they were, whatever their names.

    Rows to drop are named by id and a 64-bit hash of the text, so repeated and null ids with
    unlike texts do no harm; of rows that agree in both, any one stays.
    """
    plain, back = unnamed(docs)
    id_, text = back[id_col], back[text_col]
    narrow = _narrow(plain, id_, text, sha=False)
    full = _survivors(narrow)
    groups = _groups(full)
    best = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("th") == F.col("keep_th"))
    drop = stored(full.join(groups, "digest").where(~best).select(F.col("id").alias("__id"), F.col("th").alias("__gone")))
    again = stored(full.join(groups, "digest").where(best & (F.col("n") > 1)).select(F.col("id").alias("__id"), F.col("th").alias("__gone")))
    discard(narrow, full, groups)
    marked = plain.withColumn("__th", F.xxhash64(text))
    same = F.col(id_).eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__gone"))
    out = marked.join(drop, same, "left_anti")
    if not again.isEmpty():
        once = marked.join(again, same, "left_semi").dropDuplicates([id_, "__th"])
        out = out.join(again, same, "left_anti").unionByName(once)
    return out.select(*plain.columns).toDF(*docs.columns)
