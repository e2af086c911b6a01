"""Substring dedup by content-defined chunking with a gear rolling hash.

A chunk ends where the gear hash of the last bytes has MASK_BITS zero bits, so
an insertion moves only the borders near it. Chunks meet by digest in packed
buckets; every occurrence of a chunk but the first (by doc_id, then position)
is a repeat, and runs of repeats of at least LEAST_RUN bytes are cut out.
Chunk lengths are bounded, so buckets hold a bounded share of the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from timelog.llm.common import buckets, release, stored
from timelog.llm.packed import KEYED, PACK, by_document, dealt, done, heap, keyed, opened, passed
from timelog.llm.suffix import _flushed, finished, spans_by_document

MASK_BITS = 5
LEAST, MOST = 16, 128
#: Shorter runs of repeated chunks stay: a few common words in a row are no copied passage.
LEAST_RUN = 160
_WINDOW = 32
_PIECE = 1 << 20


def gear_table(seed: int = 42) -> np.ndarray:
    """A random 32-bit number per byte value."""
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, np.uint32)


def gear_hashes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """h[i] = sum of table[data[i - k]] << k over the last 32 bytes: what h = (h << 1) + table[byte] holds after byte i."""
    h, size = table[data], 1
    while size < _WINDOW:
        h[size:] += h[:-size] << np.uint32(size)  # the right side is evaluated first
        size *= 2
    return h


def chunk_ends(data: np.ndarray, starts: np.ndarray, table: np.ndarray) -> list[list[int]]:
    """The ends of each text's chunks. A border depends on the 32 bytes before it and on where the chunk began."""
    spots = []
    for at in range(0, len(data), _PIECE):
        low = max(0, at - _WINDOW + 1)
        h = gear_hashes(data[low : at + _PIECE], table)[at - low :]
        spots.append(np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + at + 1)
    spot = np.concatenate([np.zeros(0, np.int64), *spots])
    bounds = np.searchsorted(spot, starts)
    out = []
    for k, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
        ends, last = [], a
        # Hashes near the start of a text have seen bytes of the one before; LEAST and the window keep those out.
        for s in spot[bounds[k] : bounds[k + 1] + 1].tolist():
            if s >= b:
                break
            if s < a + _WINDOW:
                continue
            while s - last > MOST:
                last += MOST
                ends.append(last)
            if s - last >= LEAST:
                last = s
                ends.append(s)
        while b - last > MOST:
            last += MOST
            ends.append(last)
        if b > last:
            ends.append(b)
        out.append(ends)
    return out


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, spans): packed byte spans of chunks that occur earlier, by (id, position), anywhere in the corpus."""
    n_buckets = buckets(docs)
    table = gear_table()

    def take(batch, data, starts):
        ends = chunk_ends(data, starts, table)
        size = np.array([len(e) for e in ends], np.int64)
        doc = np.repeat(np.arange(len(ends)), size)
        end = np.fromiter((x for e in ends for x in e), np.int64, int(size.sum()))
        begin = np.concatenate([[0], end[:-1]]) if len(end) else end
        raw = data.tobytes()
        digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(begin.tolist(), end.tolist())]), np.uint64).reshape(-1, 2)
        return doc, digest, begin - starts[doc], (end - begin).astype(np.uint8)

    def flush(ids, ths, doc, digest, pos, size):
        order = np.lexsort((pos, ths[doc], ids[doc], digest[:, 1], digest[:, 0]))
        d = digest[order]
        new = np.concatenate([[True], (d[1:] != d[:-1]).any(axis=1)]) if len(d) else np.zeros(0, bool)
        again, first = order[~new], order[new]
        rows = done(ids, ths, doc[again], pos[again], pos[again] + size[again], n_buckets)
        bucket = (digest[first, 0] >> np.uint64(32)).astype(np.int64) % n_buckets
        return rows + dealt(bucket, ids, ths, doc[first], digest[first, 0], digest[first, 1], pos[first].astype(np.uint32), size[first])

    def settle(key, held):
        out = [passed(held)]
        parts = [opened(r, np.uint64, np.uint64, np.uint32, np.uint8) for r in heap(held)]
        if parts:
            ids, ths = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            one, two, pos, size = (np.concatenate([p[2][k] for p in parts]) for k in range(4))
            pos = pos.astype(np.int64)
            order = np.lexsort((pos, ths, ids, two, one))
            again = order[1:][(one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])]
            out.append(spans_by_document(ids[again], ths[again], pos[again], pos[again] + size[again]))
        return pa.concat_tables(out)

    found = keyed(docs, id_col, text_col).mapInArrow(lambda it: _flushed(it, take, flush, 200_000), PACK).groupBy("bucket").applyInArrow(settle, KEYED)
    spans = stored(by_document(found))
    release(docs.sparkSession)
    return spans


def chunk_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_run: int = LEAST_RUN, with_text: bool = False) -> DataFrame:
    """Per row of `docs`: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the remaining bytes).

    Null is an empty text and has no chunks. The first occurrence of a chunk
    stays, within a document too. Rows that repeat id and text are one document
    here and keep the same bytes. Runs shorter than `least_run` bytes stay.
    """
    return finished(docs, repeated_chunks(docs, id_col, text_col), id_col, text_col, with_text, least_run)
