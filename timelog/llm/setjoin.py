"""Pairs of texts whose shingle sets have a Jaccard similarity of 0.8 or more, without loss.

A text is the set of hashes of its five-word shingles; equal sets are one
vertex, named by a hash of the set (sig). Shingles meet in packed buckets,
which count the sets that hold each; those of one set only match nothing and
are not sent back. Answers go, packed too, to a bucket of the set's name. A set
of which over a fifth is alone has no partner. The others are filed under the
rarest of their shingles, as many as any partner must share one of (prefix
filter).

The members of a shingle are not paired off. Each set has a bitmap of BITS
bits, the parities of its shingles by hash, and the distance of two bitmaps is
never above the number of shingles that only one of the sets has. So bit-sliced
counters find the pairs that can be similar at all, whatever the size of the
group, and only such pairs are held against each other by their whole sets.

Components are what is wanted, so a pair is not compared once its ends are
linked otherwise. In the first two rounds each member of a shingle hands on the
least and the greatest of its possible partners only, which joins nearly all of
a large group with two pairs a member; the last round compares all possible
pairs that are still apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timelog.llm import bitslice
from timelog.llm.common import buckets, byte_slices, discard, release, stored, utf8
from timelog.llm.packed import PACK, dealt, heap, opened, packed_batch

SHINGLE = 5
#: Links are pairs with NUM / DEN of the union of their shingles in common, or more.
NUM, DEN = 4, 5
#: Bits of a set's bitmap.
BITS = 512
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's five-word shingles; a shorter text is one shingle, a text without words none."""
    tokens = text.translate(_FOLD).split()
    size = min(SHINGLE, len(tokens))
    if not size:
        return np.zeros(0, np.uint64)
    word = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    count = len(word) - size + 1
    h = np.full(count, size, np.uint64)
    for k in range(size):
        h = h * _MIX + word[k : k + count]
    return np.unique(h ^ (h >> np.uint64(29)))


def signature(own: np.ndarray) -> int | None:
    """The name of a shingle set as a signed long; None for no shingles."""
    return xxhash.xxh64_intdigest(own.tobytes(), 42) - (1 << 63) if len(own) else None


def least_overlap(n: np.ndarray) -> np.ndarray:
    """How many of its n shingles a set must share with any partner."""
    return -(-NUM * n // DEN)


def _prefixes(docs: DataFrame, text_col: str) -> DataFrame:
    """(sig, n, c, tokens, bits, prefix): sets that can have a partner, their size, their c shared shingles in order with their bitmap, and the rarest of them."""
    n_buckets = buckets(docs, 8 << 20)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        rows = 0

        def flush() -> pa.RecordBatch:
            sig = np.fromiter(held, np.int64, len(held))
            size = np.fromiter(map(len, held.values()), np.int64, len(held))
            h = np.concatenate(list(held.values()))
            bucket = (h >> np.uint64(32)).astype(np.int64) % n_buckets
            # 32 bits tell the shingles of a bucket apart; a collision only makes one look less rare.
            return packed_batch(dealt(bucket, sig, size, np.repeat(np.arange(len(held)), size), h.astype(np.uint32)))

        for whole in batches:
            for batch in byte_slices(whole, "text", 4 << 20):
                for text in utf8(batch.column("text")):
                    own = shingles(text)
                    if len(own) and (sig := signature(own)) not in held:
                        held[sig] = own
                        rows += len(own)
                    if rows >= 1 << 20:
                        yield flush()
                        held, rows = {}, 0
        if held:
            yield flush()

    def count(key, table):
        parts = [opened(r, np.uint32) for r in heap(table)]
        sig, n = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        h = np.concatenate([p[2][0] for p in parts])
        del parts
        order = np.lexsort((sig, h))
        sig, n, h = sig[order], n[order], h[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (sig[1:] != sig[:-1])])
        sig, n, h = sig[new], n[new], h[new]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        sets = np.diff(np.append(first, len(h)))
        sets = np.repeat(sets, sets)
        keep = np.flatnonzero(sets > 1)
        keep = keep[np.argsort(sig[keep], kind="stable")]
        sig, n, h = sig[keep], n[keep], h[keep]
        # How common a shingle is, in eighths of a doubling: all that the order of prefixes needs.
        common = np.minimum(8 * np.log2(sets[keep]), 255).astype(np.uint8)
        lead = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, int)
        doc = np.repeat(np.arange(len(lead)), np.diff(np.append(lead, len(sig))))
        rows = dealt((sig.view(np.uint64) >> np.uint64(33)).astype(np.int64) % n_buckets, sig[lead], n[lead], doc, h, common)
        at = key[0].as_py()
        return pa.Table.from_batches([packed_batch([(r[0], 1, at, *r[3:]) for r in rows])])

    def gather(key, table):
        sig, n, token, common = [], [], [], []
        for at, a, b, c in zip(table["id"].to_pylist(), table["a"], table["b"], table["c"]):
            s, m, (h, rare) = opened((a.as_buffer(), b.as_buffer(), c.as_buffer()), np.uint32, np.uint8)
            sig.append(s)
            n.append(m)
            token.append(h.astype(np.uint64) | np.uint64(at << 32))
            common.append(rare)
        sig, n, token, common = map(np.concatenate, (sig, n, token, common))
        order = np.lexsort((token, sig))
        sig, n, token, common = sig[order], n[order], token[order], common[order]
        lead = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        rows = []
        for a, b in zip(lead.tolist(), np.append(lead[1:], len(sig)).tolist()):
            size, own = int(n[a]), token[a:b]
            # Alone stand the size - len(own) others: the rarest, so they come first in the prefix.
            spare = size - int(least_overlap(size)) - (size - len(own)) + 1
            if spare > 0:
                rarest = np.lexsort((own, common[a:b]))[:spare]
                rows.append((int(sig[a]), size, len(own), own.view(np.int64), bitmap(own).tobytes(), own[rarest].view(np.int64)))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())]
        cols = list(zip(*rows)) if rows else [[]] * 6
        return pa.table([pa.array(c, t) for c, t in zip(cols, types)], ["sig", "n", "c", "tokens", "bits", "prefix"])

    texts = docs.select(F.col(text_col).alias("text"))
    answers = texts.mapInArrow(deal, PACK).groupBy("bucket").applyInArrow(count, PACK)
    return answers.groupBy("bucket").applyInArrow(gather, "sig long, n long, c long, tokens array<long>, bits binary, prefix array<long>")


def bitmap(own: np.ndarray) -> np.ndarray:
    """The parities of the shingles by hash, as words of 64 bits."""
    mixed = own * _MIX
    odd = np.bincount((mixed >> np.uint64(40)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def slack(n: np.ndarray, c: np.ndarray) -> np.ndarray:
    """What a set of n shingles, c of them shared, adds to the most shared shingles that only one of two partners may have, times NUM + DEN.

    An overlap of NUM / (NUM + DEN) of both sizes leaves 1 / (NUM + DEN) of them
    to shingles of one set alone, of which those that no set shares are spent.
    """
    return n - (NUM + DEN) * (n - c)


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)


def possible_pairs(token: np.ndarray, sig: np.ndarray, label: np.ndarray, n: np.ndarray, c: np.ndarray, bits: np.ndarray, most: int = 1 << 13) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(names, a, b): pairs of places in `names`, members of a token that have unlike labels, and sizes and bitmaps that allow a link."""
    order = np.lexsort((sig, n, token))
    token, sig, label, n, c, bits = token[order], sig[order], label[order], n[order], c[order], bits[order]
    lanes = bitslice.Lanes(token, bits)
    room = slack(n, c)
    held = lanes.index.reshape(-1, 64)
    best = np.where(held >= 0, room[held], np.iinfo(np.int64).min // 4).max(axis=1)
    shortest = np.where(held >= 0, n[held], np.iinfo(np.int64).max // 8).min(axis=1)
    # Where all labels of a word are one, members of that label need not look at it.
    low = np.where(held >= 0, label[held], np.iinfo(np.int64).max).min(axis=1)
    high = np.where(held >= 0, label[held], np.iinfo(np.int64).min).max(axis=1)
    # A partner has DEN / NUM of a set's shingles at most; members stand in order of size.
    for q, word in lanes.stretches(lanes.end, 8 * most):
        look = (NUM * shortest[word] <= DEN * n[q]) & ~((low[word] == label[q]) & (high[word] == label[q]))
        q, word = q[look], word[look]
        for at in range(0, len(q), most):
            mine, there = q[at : at + most], word[at : at + most]
            radius = (room[mine] + best[there]) // (NUM + DEN)
            row, lane = bitslice.near_lanes(bits[mine], lanes.planes, there, lanes.valid[there], np.minimum(radius, BITS))
            a, b = mine[row], lanes.index[there[row] * 64 + lane]
            fit = (label[a] != label[b]) & (room[a] + room[b] >= 0) & (NUM * np.maximum(n[a], n[b]) <= DEN * np.minimum(n[a], n[b]))
            a, b = a[fit], b[fit]
            # The radius was that of the roomiest set in a word of lanes: a pair of sets has its own.
            far = np.zeros(len(a), np.int64)
            for k in range(bits.shape[1]):
                far += np.bitwise_count(bits[a, k] ^ bits[b, k])
            near = (NUM + DEN) * far <= room[a] + room[b]
            if near.any():
                yield sig, a[near], b[near]


def hooks(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Of the possible partners of each member the first and the last, as pairs of names."""
    first = last = None
    for names, a, b in found:
        if first is None:
            first, last = np.full(len(names), len(names)), np.full(len(names), -1)
        for x, y in ((a, b), (b, a)):
            np.minimum.at(first, x, y)
            np.maximum.at(last, x, y)
    if first is None:
        return np.zeros((0, 2), np.int64)
    own = np.flatnonzero(last >= 0)
    return _distinct_pairs(np.concatenate([names[own], names[own]]), np.concatenate([names[first[own]], names[last[own]]]))


def _candidates(filed: DataFrame, all_pairs: bool) -> DataFrame:
    """(a, b): distinct pairs of sets to compare. `filed` has token, sig, label, n, c, bits."""
    few = int(filed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["token", "sig", "label", "n", "c", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0

        def pairs() -> Iterator[pa.RecordBatch]:
            if held:
                found = possible_pairs(*(np.concatenate([h[k] for h in held]) for k in range(len(names))))
                for got in (_distinct_pairs(s[a], s[b]) for s, a, b in found) if all_pairs else [hooks(found)]:
                    yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["a", "b"])

        # Sorted by token: a piece ends where a token ends.
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in names[:5]]
            cols.append(np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(-1, BITS // 64))
            if rows >= 1 << 17 and len(cols[0]) and cols[0][-1] != held[-1][0][-1]:
                cut = int(np.argmax(cols[0] != held[-1][0][-1]))
                held.append([c[:cut] for c in cols])
                yield from pairs()
                held, rows, cols = [], 0, [c[cut:] for c in cols]
            if len(cols[0]):
                held.append(cols)
                rows += len(cols[0])
        yield from pairs()

    dealt_out = filed.select(*names).repartition(few, "token").sortWithinPartitions("token")
    return dealt_out.mapInArrow(run, "a long, b long").distinct()


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose whole shingle sets are similar enough."""
    both = pairs
    for x in ("a", "b"):
        both = both.join(sets.select(F.col("sig").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"t_{x}")), x)
    common = F.size(F.array_intersect("t_a", "t_b")).cast("long")
    return both.where((NUM + DEN) * common >= NUM * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def joined_roots(docs: DataFrame, text_col: str, least: DataFrame, roots_of: Callable[[DataFrame | None], DataFrame]) -> DataFrame:
    """Components with every link of similar sets: the last result of roots_of.

    `least` has sig and rep, the vertex of a set; roots_of adds links (u, v) of
    vertices to what it was given before and returns (node, root).
    """
    sets = stored(_prefixes(docs, text_col))
    release(docs.sparkSession)
    roots = roots_of(None)
    filed = sets.select("sig", "n", "c", F.explode("prefix").alias("token"))
    reps = stored(sets.select("sig").join(least, "sig"))
    a, b = (reps.select(F.col("sig").alias(x), F.col("rep").alias(f"rep_{x}")) for x in ("a", "b"))
    spent: list[DataFrame] = []
    for all_pairs in (False, False, True):
        label = reps.join(roots, F.col("rep") == F.col("node"), "left").select("sig", F.coalesce("root", "rep").alias("label"))
        rows = filed.select("sig", "n", "c", "token").join(label, "sig")
        apart = rows.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token")
        filed = stored(rows.join(apart, "token"))
        discard(*spent)
        met = filed.join(sets.select("sig", "bits"), "sig")
        links = stored(_linked(_candidates(met, all_pairs), sets).join(a, "a").join(b, "b").select(F.least("rep_a", "rep_b").alias("u"), F.greatest("rep_a", "rep_b").alias("v")))
        spent = [filed]
        release(docs.sparkSession)
        if not links.isEmpty():
            roots = roots_of(links)
        discard(links)
    discard(sets, reps, *spent)
    return roots
