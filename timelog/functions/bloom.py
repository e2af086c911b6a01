"""Bloom filter arithmetic: sizes, positions by double hashing, and when a filter is worn out.

Dedup itself uses exact anti-joins; this is for stores that keep such a filter
before their keys and want its figures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelog.functions.scalars import FNV_BASIS_HIGH, FNV_BASIS_LOW, FNV_PRIME_LOW, fnv1a64

# Fixed value: what the second hash mixes into the basis before the key.
SALT = 0xABCDEF
# Bits for an item by the highest false-positive rate they serve, and the bits beyond.
BITS_PER_ITEM, BITS_BEYOND = ((0.001, 15), (0.01, 10)), 8


def sizing(items: int, rate: float) -> tuple[int, int]:
    """(bits, hashes) of a filter: bits in whole words of 64 and 1024 at least, 3 to 7 hashes."""
    each = next((bits for most, bits in BITS_PER_ITEM if rate <= most), BITS_BEYOND)
    return -(-max(items * each, 1024) // 64) * 64, min(7, max(3, int(each * 0.7)))


def positions(key: Column, bits: int, hashes: int) -> Column:
    """The bits of a key: first hash + i * second hash, both FNV-1a in 64 bits, modulo `bits` (below 2**31)."""
    prime = (1 << 40) + FNV_PRIME_LOW
    start = (((FNV_BASIS_HIGH << 32) + FNV_BASIS_LOW) ^ SALT) * prime % (1 << 64)
    both = F.struct(fnv1a64(key).alias("a"), fnv1a64(key, start=(start >> 32, start & 0xFFFFFFFF)).alias("b"))

    def at(i: int, h: Column) -> Column:
        low = h["a"]["lo"] + h["b"]["lo"] * i
        high = (h["a"]["hi"] + h["b"]["hi"] * i + F.shiftrightunsigned(low, 32)).bitwiseAND(F.lit(0xFFFFFFFF))
        return ((high % bits) * ((1 << 32) % bits) + low.bitwiseAND(F.lit(0xFFFFFFFF)) % bits) % bits

    return F.transform(F.array(both), lambda h: F.array(*(at(i, h) for i in range(hashes))))[0]


def probe(known: DataFrame, asked: DataFrame, key: str, bits: int, hashes: int) -> DataFrame:
    """One row: the items in the filter, bits set, lookups, those it answers with no, and those it lets through by mistake."""
    items = known.select(F.col(key).cast("string").alias("k")).distinct()
    rows = asked.select(F.col(key).cast("string").alias("k")).distinct()
    on = items.select(F.explode(positions(F.col("k"), bits, hashes)).alias("at")).distinct()
    # Positions of one key may coincide: all of its distinct ones must be set.
    want = rows.select("k", F.explode(F.array_distinct(positions(F.col("k"), bits, hashes))).alias("at"))
    hit = want.join(on.withColumn("set", F.lit(1)), "at", "left").groupBy("k").agg((F.count("set") == F.count("*")).alias("maybe"))
    seen = hit.join(items.withColumn("there", F.lit(True)), "k", "left")
    wrong = F.col("maybe") & F.col("there").isNull()
    out = seen.agg(F.count("*").alias("lookups"), F.count_if(~F.col("maybe")).alias("rejected"), F.count_if(wrong).alias("false_positives"), F.count_if(F.col("maybe") & F.col("there")).alias("hits"))
    return out.select(items.agg(F.count("*")).scalar().alias("items"), on.agg(F.count("*")).scalar().alias("bits_set"), "*")


def worn_out(hits: Column, false_positives: Column, most: float = 0.05, least_lookups: int = 1000) -> Column:
    """Whether a filter should be rebuilt: false positives among what it let through are above a share, once there are enough lookups to tell."""
    through = hits + false_positives
    return (through >= least_lookups) & (false_positives / F.greatest(through, F.lit(1)) > most)
