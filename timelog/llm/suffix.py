"""Suffix-array dedup: bytes covered by a long string that an earlier document has too.

1. Anchors: of every `length`-byte window the first GRAM-byte string of least
   hash is its anchor, so equal windows have equal anchors. Packed anchor hashes
   meet by bucket; documents get the anchors that another document shares.
2. Contexts: the windows of an anchor follow each other and form its context.
   Equal contexts inside a task are settled there; one of each goes to the
   bucket of its anchor.
3. A window reaches half its other bytes beyond its anchor on one side, so a
   context is of use only if it shares a half with another document's. In a
   bucket, the distinct contexts of use are sorted into a suffix array (by the
   first symbols, as many as the windows need), and intervals of the
   Burrows-Wheeler transform are expanded breadth first: strings are extended
   backwards, and the extension at step l finds the borders between suffixes
   whose common prefix is l - 1. It stops at `length`: suffixes that no border
   separates share `length` bytes, and the least document of each such class is
   the one that keeps its bytes.

Everything is decided on the input text; offsets are UTF-8 bytes. All buckets
hold a bounded share of the input whatever is repeated: a passage of a third of
all documents is one entry per task and bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timelog.llm.common import NO_ID, buckets, byte_slices, discard, release, stored
from timelog.llm.packed import KEYED, PACK, by_document, cut_out, dealt, done, heap, joined_spans, keyed, opened, packed_batch, passed, slice_bytes, text_hash

LENGTH = 50
GRAM = 16
_FLUSH = 400_000
_PIECE = 1 << 18
_MULT = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the `gram` bytes (a power of two) from each position on."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(_MULT)
    h ^= h >> np.uint64(29)
    size = 1
    while size < gram:
        h = h[:-size] * np.uint64(pow(_MULT, size, 1 << 64)) + h[size:] if len(h) > size else h[:0]
        size *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def anchors(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows inside the texts that `starts` delimits: position, hash, and the first and last window of each."""
    width = length - gram + 1
    found, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    total = len(data) - length + 1
    for at in range(0, max(0, total), _PIECE):
        n = min(_PIECE, total - at)  # windows that begin here
        h = gram_hashes(data[at : at + n + length - 1], gram)
        h32 = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        low = _sliding(h32, width, np.minimum)
        # Windows over the end of a text have no anchor.
        inner = starts[np.searchsorted(starts, at, "right") : np.searchsorted(starts, at + n + length, "left")]
        for e in inner.tolist():
            low[max(0, e - at - length + 1) : max(0, e - at)] = 0
        pad = np.zeros(width - 1, np.uint32)
        high = _sliding(np.concatenate([pad, low, pad]), width, np.maximum)
        p = np.flatnonzero(high == h32)
        found.append(p + at)
        hashes.append(h[p])
    p, h = np.concatenate(found), np.concatenate(hashes)
    if len(found) > 2:
        p, once = np.unique(p, return_index=True)
        h = h[once]
    return (p, h, *_own_windows(p, h, starts, length, width))


def _own_windows(p: np.ndarray, h: np.ndarray, starts: np.ndarray, length: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last window whose first least hash is at p; last < first if there is none.

    A window belongs to the anchor p unless it holds an anchor of lower hash, or of
    equal hash before p; that anchor is at most width - 1 positions away.
    """
    rank = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    doc = np.searchsorted(starts, p, "right") - 1
    first = np.maximum(starts[doc], p - width + 1)
    last = np.minimum(p, starts[doc + 1] - length)
    for way in (-1, 1):
        open_, step = np.arange(len(p)), 0
        while len(open_):
            step += way
            open_ = open_[(open_ + step >= 0) & (open_ + step < len(p))]
            other = open_ + step
            near = np.abs(p[other] - p[open_]) < width
            open_, other = open_[near], other[near]
            beats = rank[other] <= rank[open_] if way < 0 else rank[other] < rank[open_]
            if way < 0:
                first[open_[beats]] = np.maximum(first[open_[beats]], p[other[beats]] + 1)
            else:
                last[open_[beats]] = np.minimum(last[open_[beats]], p[other[beats]] - width)
            open_ = open_[~beats]
    return first, last


def _flushed(batches: Iterator[pa.RecordBatch], take, flush, most: int) -> Iterator[pa.RecordBatch]:
    """Feed slices of texts to `take`, which returns a list of arrays per slice; `flush` gets them joined, with ids and hashes."""
    held, ids, ths, rows, docs = [], [], [], 0, 0
    for whole in batches:
        for batch in byte_slices(whole, "text", 2 << 20):
            i, t, data, starts = slice_bytes(batch)
            doc, *cols = take(batch, data, starts)
            held.append((doc + docs, *cols))
            ids.append(i)
            ths.append(t)
            docs += len(i)
            rows += len(doc)
            if rows >= most:
                yield packed_batch(flush(np.concatenate(ids), np.concatenate(ths), *map(np.concatenate, zip(*held))))
                held, ids, ths, rows, docs = [], [], [], 0, 0
    if held:
        yield packed_batch(flush(np.concatenate(ids), np.concatenate(ths), *map(np.concatenate, zip(*held))))


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, int)
    return starts, np.diff(np.append(starts, len(values)))


def shared_anchors(docs: DataFrame, length: int, n_buckets: int) -> DataFrame:
    """Keyed documents -> a row of KEYED per document with anchors that two documents or more have.

    `spans` holds their positions, 4 bytes each, then 256 * before + after, 2 bytes
    each: the bytes of the anchor's context on either side. Answers go back in
    packed rows too, to a bucket of the document's id.
    """

    def take(batch, data, starts):
        p, h, first, last = anchors(data, starts, length)
        own = first <= last
        p, h, first, last = p[own], h[own], first[own], last[own]
        doc = np.searchsorted(starts, p, "right") - 1
        return doc, h, (p - starts[doc]).astype(np.uint32), ((p - first) * 256 + last + length - p - GRAM).astype(np.uint16)

    def flush(ids, ths, doc, h, pos, sides):
        order = np.lexsort((ids[doc], h))
        doc, h, pos, sides = doc[order], h[order], pos[order], sides[order]
        begin, size = _runs(h)
        several = np.repeat(np.maximum.reduceat(ids[doc], begin) > ids[doc[begin]], size) if len(begin) else np.zeros(0, bool)
        rows = dealt(ids[doc[several]] % n_buckets, ids, ths, doc[several], pos[several], sides[several], kind=2)
        # Of hashes settled here one entry goes on, to tell others of the least id; of the rest all, which are of one id.
        on = ~several
        on[begin] = True
        doc, h, pos, sides = doc[on], h[on], pos[on], sides[on]
        return rows + dealt((h >> np.uint64(32)).astype(np.int64) % n_buckets, ids, ths, doc, h.astype(np.uint32), pos, sides)

    def share(key, table):
        parts = [opened(r, np.uint32, np.uint32, np.uint16) for r in heap(table)]
        settled = table.filter(pa.compute.equal(table["kind"], 2))
        if not parts:
            return settled
        ids, ths = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        h, pos, sides = (np.concatenate([p[2][k] for p in parts]) for k in range(3))
        order = np.lexsort((ids, h))
        begin, size = _runs(h[order])
        least = np.repeat(ids[order][begin], size)
        most = np.repeat(np.maximum.reduceat(ids[order], begin), size)
        mine = order[most > least]
        ids, ths, pos, sides = (x[mine] for x in (ids, ths, pos, sides))
        order = np.lexsort((ths, ids))
        new = np.flatnonzero(np.concatenate([[True], (np.diff(ids[order]) != 0) | (np.diff(ths[order]) != 0)])) if len(order) else order
        doc = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))
        lead = order[new]
        rows = dealt(ids[order] % n_buckets, ids[lead], ths[lead], doc, pos[order], sides[order], kind=2)
        return pa.concat_tables([settled, pa.Table.from_batches([packed_batch(rows)])])

    def gather(key, table):
        parts = [opened(r, np.uint32, np.uint16) for r in heap(table, 2)]
        ids, ths = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        pos, sides = (np.concatenate([p[2][k] for p in parts]) for k in (0, 1))
        order = np.lexsort((pos, ths, ids))
        ids, ths, pos, sides = (x[order] for x in (ids, ths, pos, sides))
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(ids) != 0) | (np.diff(ths) != 0)])) if len(ids) else order
        blobs = [pos[a:b].tobytes() + sides[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(ids)))]
        return pa.table({"id": pa.array(ids[cut], pa.int64()), "th": pa.array(ths[cut], pa.int64()), "spans": pa.array(blobs, pa.binary())})

    found = docs.mapInArrow(lambda it: _flushed(it, take, flush, _FLUSH), PACK).groupBy("bucket").applyInArrow(share, PACK)
    return found.groupBy("bucket").applyInArrow(gather, KEYED)


def spans_by_document(ids: np.ndarray, ths: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Table:
    order = np.lexsort((ths, ids))
    ids, ths = ids[order], ths[order]
    pairs = np.stack([begin[order], end[order]], 1).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (ths[1:] != ths[:-1])])) if len(ids) else np.zeros(0, int)
    blobs = [pairs[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(ids)))]
    return pa.table({"id": pa.array(ids[cut], pa.int64()), "th": pa.array(ths[cut], pa.int64()), "spans": pa.array(blobs, pa.binary())})


def _sorted_ranks(key: np.ndarray, bits: int, used: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of keys of `used` bits and the dense rank of each; where `bits` more fit, by one plain sort of keys with positions attached."""
    n = len(key)
    if used + bits <= 64:
        both = key << np.uint64(bits)
        both |= np.arange(n, dtype=np.uint64)
        both.sort()
        order = (both & np.uint64((1 << bits) - 1)).astype(np.int64)
        both >>= np.uint64(bits)
    else:
        order = np.argsort(key, kind="stable")
        both = key[order]
    ranks = np.empty(n, np.uint64)
    step = np.zeros(n, np.uint64)
    np.not_equal(both[1:], both[:-1], out=step[1:], casting="unsafe")
    ranks[order] = np.cumsum(step, dtype=np.uint64)
    return order, ranks


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of rows of symbols (0 ends a row, every row ends in 0), in order of their first `depth` symbols at least."""
    n = len(symbols)
    used = np.unique(symbols)
    dense = np.zeros(int(used[-1]) + 1, np.uint64)
    dense[used] = np.arange(len(used)) if used[0] == 0 else np.arange(1, len(used) + 1)
    code = dense[symbols]
    bits, width = max(1, n.bit_length()), int(code.max()).bit_length() or 1
    size = max(1, (63 - bits) // width)
    ends = np.flatnonzero(symbols == 0)
    left = np.repeat(ends, np.diff(np.concatenate([[-1], ends]))) - np.arange(n)  # symbols before the row's end
    key = code.copy()
    for k in range(1, size):
        key <<= np.uint64(width)
        if k >= n:
            continue
        key[: n - k] |= np.where(left[: n - k] > k, code[k:], np.uint64(0))
    order, ranks = _sorted_ranks(key, bits, size * width)
    while size < depth:
        after = np.zeros(n, np.uint64)
        inside = np.flatnonzero(left > size)
        after[inside] = ranks[inside + size] + np.uint64(1)
        order, ranks = _sorted_ranks(ranks << np.uint64(bits) | after, bits, 2 * bits)
        size *= 2
    return order


def prefix_borders(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """border[k]: suffixes k-1 and k of the order share fewer than `length` symbols.

    Threshold-bounded interval expansion: from the interval of the empty string,
    all intervals of strings of l symbols are extended backwards by one symbol,
    l = 1, 2, ...; the right end of a new interval, if not yet marked, is a border
    of common prefix l - 1, and only intervals that mark one are extended again.
    """
    n = len(symbols)
    bwt = np.concatenate([symbols[:1] * 0, symbols[:-1]])[order]
    by_symbol = np.argsort(bwt, kind="stable")  # rows in order of (symbol, row), which is where they lead
    reached = np.empty(n, np.int32)
    reached[by_symbol] = np.arange(n, dtype=np.int32)
    sorted_bwt = bwt[by_symbol]
    following = np.full(n, n, np.int32)  # next row with the same symbol
    same = sorted_bwt[1:] == sorted_bwt[:-1]
    following[by_symbol[:-1][same]] = by_symbol[1:][same]
    following[bwt == 0] = -1  # nothing goes on before the start of a row
    keys = sorted_bwt.astype(np.int64) * n + by_symbol
    used = np.unique(sorted_bwt[sorted_bwt > 0]).astype(np.int64) * n
    border = np.zeros(n + 1, bool)
    border[0] = border[n] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        size = high - low
        if 4 * len(low) * len(used) < size.sum():
            # Few wide intervals: count each symbol before either end.
            new_low = np.searchsorted(keys, (used + low[:, None]).reshape(-1))
            right = np.searchsorted(keys, (used + high[:, None]).reshape(-1))
            new = (right > new_low) & ~border[right]
            low, high = new_low[new], right[new]
        else:
            # Many narrow ones: look at the last row of each symbol inside.
            owner = np.repeat(np.arange(len(low)), size)
            row = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size - low, size)
            last = np.flatnonzero(following[row] >= np.repeat(high, size))
            row, owner = row[last], owner[last]
            right = reached[row] + 1
            new = ~border[right]
            row, owner, high = row[new], owner[new], right[new]
            low = np.searchsorted(keys, bwt[row].astype(np.int64) * n + low[owner])
        border[high] = True
        if not len(low):
            break
    return border[:n]


def window_owners(contexts: np.ndarray, lead: np.ndarray, tail: np.ndarray, owner: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """contexts [n, c] bytes, of which the first `lead` and last `tail` are padding -> least owner of each window start [n, c - length + 1]."""
    n, width = contexts.shape
    at = np.arange(width + 1)
    there = (at >= lead[:, None]) & (at <= width - tail[:, None])  # with one symbol more, which ends the row
    row, t = np.nonzero(there)
    symbols = np.zeros((n, width + 1), np.uint16)
    symbols[:, :width] = contexts
    symbols = symbols[there] + np.uint16(1)
    symbols[t == (width - tail)[row]] = 0
    order = suffix_order(symbols, length)
    border = prefix_borders(symbols, order, length)
    row, t = row[order], t[order]
    valid = t + length <= width - tail[row]
    value = np.where(valid, owner[row], NO_ID)
    begin = np.flatnonzero(border)
    least = np.repeat(np.minimum.reduceat(value, begin), np.diff(np.append(begin, len(value))))
    out = np.full((n, width - length + 1), NO_ID, np.int64)
    out[row[valid], t[valid]] = least[valid]
    return out


def covered(docs: DataFrame, shared: DataFrame, length: int, n_buckets: int) -> DataFrame:
    """Keyed documents and their shared anchors -> rows of KEYED: byte spans that a document of smaller id has too."""
    reach = length - GRAM
    width = 2 * reach + GRAM

    def take(batch, data, starts):
        padded = np.concatenate([np.zeros(reach, np.uint8), data, np.zeros(width, np.uint8)])
        lists = batch.column("spans").to_pylist()
        pairs = [np.stack([np.frombuffer(x, np.uint32, len(x) // 6), np.frombuffer(x, np.uint16, len(x) // 6, len(x) // 6 * 4)], 1).astype(np.int64) for x in lists]
        pairs = [x[np.unique(x[:, 0], return_index=True)[1]] for x in pairs]
        doc = np.repeat(np.arange(len(lists)), [len(x) for x in pairs])
        pos, sides = np.concatenate([np.zeros((0, 2), np.int64), *pairs]).T
        lead, tail = reach - sides // 256, reach - sides % 256
        at = np.arange(width)
        rows = padded[(pos + starts[doc])[:, None] + at]
        rows[(at < lead[:, None]) | (at >= width - tail[:, None])] = 0
        return doc, pos, lead.astype(np.uint8), tail.astype(np.uint8), rows

    def flush(ids, ths, doc, pos, lead, tail, rows):
        full = np.concatenate([rows, lead[:, None], tail[:, None]], 1).tobytes()
        step = width + 2
        digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(full[k : k + step]) for k in range(0, len(full), step)]), np.uint64).reshape(-1, 2)
        order = np.lexsort((ids[doc], digest[:, 1], digest[:, 0]))
        sorted_digest = digest[order]
        begin = np.flatnonzero(np.concatenate([[True], (sorted_digest[1:] != sorted_digest[:-1]).any(axis=1)])) if len(order) else np.zeros(0, int)
        first = np.repeat(ids[doc[order[begin]]], np.diff(np.append(begin, len(order)))) if len(order) else np.zeros(0, np.int64)
        later = ids[doc[order]] > first
        gone, lead_rows = order[later], order[~later]
        out = done(ids, ths, doc[gone], pos[gone] - reach + lead[gone], pos[gone] + GRAM + reach - tail[gone].astype(np.int64), n_buckets)
        middle = np.ascontiguousarray(rows[lead_rows, reach : reach + GRAM]).view(np.uint64)
        mixed = (middle[:, 0] * np.uint64(_MULT) ^ middle[:, 1]) * np.uint64(0xD6E8FEB86659FD93)
        bucket = (mixed >> np.uint64(32)).astype(np.int64) % n_buckets
        return out + dealt(bucket, ids, ths, doc[lead_rows], pos[lead_rows].astype(np.uint32), lead[lead_rows], tail[lead_rows], rows[lead_rows].view(f"S{width}").reshape(-1) if len(lead_rows) else rows[:0].reshape(0))

    def settle(key, table):
        out = [passed(table)]
        parts = [opened(r, np.uint32, np.uint8, np.uint8, f"V{width}") for r in heap(table)]
        if parts:
            ids, ths = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            pos, lead, tail = (np.concatenate([p[2][k] for p in parts]).astype(np.int64) for k in range(3))
            rows = np.frombuffer(b"".join(p[2][3].tobytes() for p in parts), np.uint8).reshape(-1, width)
            use = np.flatnonzero(of_use(rows, lead, tail, ids, reach))
            ids, ths, pos, lead, tail, rows = (x[use] for x in (ids, ths, pos, lead, tail, rows))
            one, back = distinct_rows(rows, lead, tail)
            least = np.full(len(one), NO_ID, np.int64)
            np.minimum.at(least, back, ids)
            by_context = np.argsort(back, kind="stable")
            first = np.searchsorted(back[by_context], np.arange(len(one) + 1))
            for group in anchor_pieces(rows[one], reach):
                owners = window_owners(rows[one[group]], lead[one[group]], tail[one[group]], least[group], length)
                count = first[group + 1] - first[group]
                slot = np.repeat(np.arange(len(group)), count)
                entry = by_context[np.arange(len(slot)) - np.repeat(np.cumsum(count) - count - first[group], count)]
                gone = owners[slot] < ids[entry][:, None]
                edge = np.diff(np.pad(gone.astype(np.int8), ((0, 0), (1, 1))), axis=1)
                r, t0 = np.nonzero(edge == 1)
                _, t1 = np.nonzero(edge == -1)
                e = entry[r]
                out.append(spans_by_document(ids[e], ths[e], pos[e] - reach + t0, pos[e] - reach + t1 - 1 + length))
        return pa.concat_tables(out)

    texts = docs.join(shared, ["id", "th"])
    return texts.mapInArrow(lambda it: _flushed(it, take, flush, 60_000), PACK).groupBy("bucket").applyInArrow(settle, KEYED)


def distinct_rows(rows: np.ndarray, lead: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of one of each distinct context, and for each context which of those it is."""
    step = rows.shape[1] + 2
    full = np.concatenate([rows, lead[:, None].astype(np.uint8), tail[:, None].astype(np.uint8)], 1).tobytes()
    digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(full[k : k + step]) for k in range(0, len(full), step)]), np.uint64).reshape(-1, 2)
    order = np.lexsort((digest[:, 1], digest[:, 0]))
    new = np.concatenate([[True], (digest[order[1:]] != digest[order[:-1]]).any(axis=1)]) if len(order) else np.zeros(0, bool)
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back


def of_use(rows: np.ndarray, lead: np.ndarray, tail: np.ndarray, ids: np.ndarray, reach: int) -> np.ndarray:
    """Contexts whose anchor, with half of a window's other bytes before or after it, a document of another id has too."""
    half = reach // 2
    use = np.zeros(len(rows), bool)
    for a, there in ((reach - half, lead <= reach - half), (reach, tail <= reach - half)):
        has = np.flatnonzero(there)
        part = np.zeros((len(has), -(-(half + GRAM) // 8) * 8), np.uint8)
        part[:, : half + GRAM] = rows[has, a : a + half + GRAM]
        key = np.zeros(len(has), np.uint64)
        for word in part.view(np.uint64).T:
            key = (key ^ word) * np.uint64(_MULT)
            key ^= key >> np.uint64(29)
        order = np.argsort(key, kind="stable")
        begin, size = _runs(key[order])
        if len(begin):
            own = ids[has[order]]
            use[has[order]] |= np.repeat(np.maximum.reduceat(own, begin) > np.minimum.reduceat(own, begin), size)
    return use


def _pieces(key: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Indices in pieces of about `most`; equal rows of `key` (words of 64 bits) stay together."""
    order = np.lexsort(key.T[::-1])
    new = np.flatnonzero(np.concatenate([[True], (key[order[1:]] != key[order[:-1]]).any(axis=1)])) if len(order) else order
    at = 0
    while at < len(order):
        k = np.searchsorted(new, at + most, "left")
        to = new[k] if k < len(new) else len(order)
        # A large group stands alone, not with what came before it.
        begin = new[k - 1] if k else 0
        if to - begin > most and begin > at:
            to = begin
        yield order[at:to]
        at = to


def anchor_pieces(rows: np.ndarray, reach: int, most: int = 2048) -> Iterator[np.ndarray]:
    """Indices of contexts in pieces of about `most`; contexts of one anchor that share a window meet in a piece.

    A window reaches half its other bytes beyond the anchor on one side. So an
    anchor of very many contexts is dealt out twice, by that half before it and
    by the half after it: contexts with a common window agree in one of them.
    """
    middle = np.ascontiguousarray(rows[:, reach : reach + GRAM]).view(np.uint64)
    half = reach // 2
    for piece in _pieces(middle, most):
        if len(piece) <= most:
            yield piece
            continue
        for a in (reach - half, reach):
            part = np.zeros((len(piece), -(-(half + GRAM) // 8) * 8), np.uint8)
            part[:, : half + GRAM] = rows[piece, a : a + half + GRAM]
            for own in _pieces(part.view(np.uint64), most):
                yield piece[own]


def repeated_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, spans) of the documents with repeats: packed byte spans covered by `length`-byte strings of a smaller id."""
    if not GRAM < length <= GRAM + 255:
        raise ValueError(f"length must be above {GRAM} and at most {GRAM + 255}")
    rows = keyed(docs, id_col, text_col)
    n = buckets(docs)
    shared = stored(shared_anchors(rows, length, n))
    release(docs.sparkSession)
    spans = stored(by_document(covered(rows, shared, length, n)))
    discard(shared)
    release(docs.sparkSession)
    return spans


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row of `docs`: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the remaining bytes).

    Null is an empty text. Rows with equal ids never remove each other's bytes; a
    null id counts as the largest. Matches do not cross documents.
    """
    return finished(docs, repeated_spans(docs, length, id_col, text_col), id_col, text_col, with_text)


def finished(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str, with_text: bool, least_run: int = 0) -> DataFrame:
    """Cut the spans out of the texts; runs shorter than `least_run` bytes stay."""
    kinds = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    names = [x.split()[0] for x in kinds.split(", ")]
    types = [pa.int64()] * 3 + [pa.string()] + [pa.binary()] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text", 4 << 20):
                rows = []
                for text, parts in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()):
                    cut = joined_spans(parts)
                    cut = cut[cut[:, 1] - cut[:, 0] >= least_run]
                    kept = cut_out(text, cut)
                    rows.append((len(text), len(text) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), kept)[: len(names)])
                yield pa.RecordBatch.from_arrays([batch.column("own"), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], [id_col, *names])

    rows = docs.select(F.col(id_col).alias("own"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("th", text_hash(F.col("text"))).join(spans, ["id", "th"], "left").select("own", "text", "spans")
    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {kinds}")
