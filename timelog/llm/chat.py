"""Chat formatting after cumulative-snapshot collapse.

Chat logs often hold a conversation again and again as it grows. Every turn
prefix of every conversation gets a 128-bit hash; conversations whose whole
hash is a proper prefix of another are dropped by an anti-join, equal ones
keep the least conv_id, and what is left is rendered.

Prefix hashes are running xors of turn hashes, which hold the turn number. A
long conversation is cut into blocks of BLOCK turn numbers: blocks are reduced
on their own, their totals give each block's start, and the running xor goes on
inside blocks, so no task gets a whole conversation. It is rendered in parts,
one per block, for the same reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelog.llm.common import discard, stored

BLOCK = 1024


def _key(column: str) -> Column:
    """A conversation id as text; rows without one are a single conversation."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("none"))


def turn_prefixes(chats: DataFrame) -> DataFrame:
    """key, conv_id, turn, h1, h2 (hash of all turns so far), n_turns so far, last. Repeated rows count once; null turns come first."""
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-1))
    content = [F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit("")), F.col("role").isNull(), F.col("text").isNull()]
    rows = chats.select(_key("conv_id").alias("key"), "conv_id", turn.alias("turn"), *(F.xxhash64(F.lit(salt), turn, *content).alias(h) for salt, h in ((1, "h1"), (2, "h2")))).distinct()
    turns = rows.groupBy("key", "turn").agg(F.min("conv_id").alias("conv_id"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
    turns = turns.withColumn("block", F.floor(F.col("turn") / BLOCK))
    blocks = turns.groupBy("key", "block").agg(F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"), F.count("*").alias("bn"), F.max("turn").alias("end"))
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    starts = blocks.select(
        "key", "block", *(F.coalesce(f(c).over(before), zero).alias(f"s{c}") for c, f in (("b1", F.bit_xor), ("b2", F.bit_xor), ("bn", F.sum))), F.max("end").over(Window.partitionBy("key")).alias("end")
    )
    so_far = Window.partitionBy("key", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    joined = turns.join(starts, ["key", "block"])
    return joined.select(
        "key", "conv_id", "turn",
        F.bit_xor("h1").over(so_far).bitwiseXOR(F.col("sb1")).alias("h1"),
        F.bit_xor("h2").over(so_far).bitwiseXOR(F.col("sb2")).alias("h2"),
        (F.count("*").over(so_far) + F.col("sbn")).alias("n_turns"),
        (F.col("turn") == F.col("end")).alias("last"),
    )


def _collapse(chats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored maximal conversations (key, conv_id, n_turns, copies), and stored links (conv_id, n_turns, kept_id) of the others."""
    prefixes = stored(turn_prefixes(chats))
    hashes = ["h1", "h2", "n_turns"]
    ends = prefixes.where("last")
    whole = ends.groupBy(*hashes).agg(F.min("conv_id").alias("conv_id"), F.min_by("key", F.struct(F.col("conv_id").isNull(), "conv_id")).alias("key"), F.count("*").alias("copies"))
    part = prefixes.where("not last").select(*hashes).distinct()
    kept = stored(whole.join(part, hashes, "left_anti").select("key", "conv_id", "n_turns", "copies"))
    # Every prefix of a maximal conversation, the whole one included, with the least conversation that has it.
    of_kept = prefixes.join(kept.select("key", F.col("conv_id").alias("kept_id")), "key").groupBy(*hashes).agg(F.min("kept_id").alias("kept_id"))
    others = ends.join(kept.select("key"), "key", "left_anti").select("conv_id", *hashes)
    links = stored(others.join(of_kept, hashes).select("conv_id", "n_turns", "kept_id"))
    discard(prefixes)
    return kept, links


def maximal_conversations(chats: DataFrame) -> DataFrame:
    """conv_id, key, n_turns, copies: conversations that no other one continues; equal ones are one with the least conv_id."""
    kept, links = _collapse(chats)
    discard(links)
    return kept


def collapsed_conversations(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, kept_id: conversations that are not maximal, and the least maximal one that equals or continues each."""
    kept, links = _collapse(chats)
    discard(kept)
    return links


def render_chats(chats: DataFrame, template: str = "<|im_start|>{role}\n{text}<|im_end|>\n", links: bool = False) -> DataFrame:
    """One row per maximal conversation and block: conv_id, part, n_turns, copies, rendered, kept_id (the conversation itself).

    With `links` also a row for each other conversation, with nulls in part,
    copies and rendered, and in kept_id the conversation that holds it.

    Null roles and texts are unlike empty ones when conversations are compared,
    and render as empty; rows of one turn stand by role, then text, each once.
    Texts are rendered as they are: one that holds the template's own marks is
    not escaped. An empty table gives no rows; other columns are not read.
    """
    head, rest = template.split("{role}")
    middle, tail = rest.split("{text}")
    keep, others = _collapse(chats)
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-1))
    rows = chats.select(_key("conv_id").alias("key"), turn.alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("part", F.floor(F.col("turn") / BLOCK)).join(keep.select("key"), "key", "left_semi")
    parts = rows.groupBy("key", "part").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(head), t["role"], F.lit(middle), t["text"], F.lit(tail))), "")
    out = parts.join(keep, "key").select("conv_id", F.col("part").cast("long").alias("part"), "n_turns", "copies", text.alias("rendered"), F.col("conv_id").alias("kept_id"))
    if not links:
        return out
    none = F.lit(None)
    return out.unionByName(others.select("conv_id", none.cast("long").alias("part"), "n_turns", none.cast("long").alias("copies"), none.cast("string").alias("rendered"), "kept_id"))
