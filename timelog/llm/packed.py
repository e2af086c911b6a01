"""Byte positions exchanged between tasks in packed form.

Fingerprints of text positions are far too many for one row each. A task sorts
what it found by bucket and sends one row per bucket with arrays inside, after
keeping one entry per fingerprint and document of least id (the others are
settled at once: a smaller document with the same content is at hand). So a
fingerprint shared by a third of all documents costs one entry per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelog.llm.common import NO_ID, flat

#: bucket: where to send the row. Rows of kind 0 are done: spans of one document. Others hold arrays.
PACK = "bucket long, kind int, id long, th long, a binary, b binary, c binary"
_NAMES = ["bucket", "kind", "id", "th", "a", "b", "c"]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
#: Documents are told apart by id and 32 bits of a text hash, so repeated ids with other texts do no harm.
KEYED = "id long, th long, spans binary"


def text_hash(text: Column) -> Column:
    return F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), text_hash(text).alias("th"), text.alias("text"))


def packed_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], _NAMES)


def done(ids: np.ndarray, ths: np.ndarray, doc: np.ndarray, begin: np.ndarray, end: np.ndarray, n_buckets: int) -> list[tuple]:
    """One finished row per document: its spans as pairs of int64. `doc` indexes ids and need not be sorted."""
    order = np.argsort(doc, kind="stable")
    doc, pairs = doc[order], np.stack([begin[order], end[order]], 1).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, int)
    return [(int(ids[d]) % n_buckets, 0, int(ids[d]), int(ths[d]), pairs[a:b].tobytes(), None, None) for a, b, d in zip(cut, np.append(cut[1:], len(doc)), doc[cut].tolist())]


def _index_kind(size: int) -> type:
    return np.uint8 if size <= 1 << 8 else np.uint16 if size <= 1 << 16 else np.uint32


def dealt(bucket: np.ndarray, ids: np.ndarray, ths: np.ndarray, doc: np.ndarray, *columns: np.ndarray, kind: int = 1) -> list[tuple]:
    """One row of `kind` per bucket: documents (id, th) of its entries in a, the entry columns joined in b, their row count in c. `doc` is the first column, in as few bytes as do."""
    order = np.lexsort((doc, bucket))
    bucket, doc = bucket[order], doc[order]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, int)
    columns = [c[order] for c in columns]
    rows = []
    for a, b in zip(cut, np.append(cut[1:], len(bucket))):
        own, back = np.unique(doc[a:b], return_inverse=True)
        # Ids are sorted in most inputs: their differences have few bytes.
        table = np.diff(ids[own], prepend=0).astype(np.int64).tobytes() + ths[own].astype(np.uint32).tobytes()
        blob = back.astype(_index_kind(len(own))).tobytes() + b"".join(np.ascontiguousarray(c[a:b]).tobytes() for c in columns)
        rows.append((int(bucket[a]), kind, None, None, table, blob, np.int64(b - a).tobytes()))
    return rows


def opened(row: tuple[bytes, bytes, bytes], *kinds: np.dtype) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Inverse of `dealt`: (id, th) of each entry, and the columns."""
    a, b, c = row
    n = int(np.frombuffer(c, np.int64)[0])
    docs = memoryview(a).nbytes // 12
    ids, ths = np.cumsum(np.frombuffer(a, np.int64, docs)), np.frombuffer(a, np.uint32, docs, 8 * docs).astype(np.int64)
    doc = np.frombuffer(b, _index_kind(docs), n)
    out, at = [], doc.nbytes
    for kind in kinds:
        kind = np.dtype(kind)
        out.append(np.frombuffer(b, kind, n, at))
        at += n * kind.itemsize
    return ids[doc], ths[doc], out


def heap(table: pa.Table, kind: int = 1) -> Iterator[tuple[bytes, bytes, bytes]]:
    """The packed rows of a bucket."""
    held = table.filter(pa.compute.equal(table["kind"], kind))
    for a, b, c in zip(held["a"], held["b"], held["c"]):
        yield a.as_buffer(), b.as_buffer(), c.as_buffer()


def passed(table: pa.Table) -> pa.Table:
    """The finished rows of a bucket."""
    held = table.filter(pa.compute.equal(table["kind"], 0))
    return pa.table({"id": held["id"], "th": held["th"], "spans": held["a"]})


def by_document(found: DataFrame) -> DataFrame:
    """Rows of KEYED -> one row per document with all its spans."""
    return found.groupBy("id", "th").agg(F.collect_list("spans").alias("spans"))


def joined_spans(parts: list[bytes] | None) -> np.ndarray:
    """Sorted maximal runs of the pairs in `parts`, as an array [n, 2]."""
    pairs = np.frombuffer(b"".join(parts or []), np.int64).reshape(-1, 2)
    if not len(pairs):
        return pairs
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.concatenate([[True], pairs[1:, 0] > reach[:-1]])
    return np.stack([pairs[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(pairs) - 1)]], 1)


def cut_out(text: bytes, spans: np.ndarray) -> bytes:
    kept, at = [], 0
    for a, b in spans.tolist():
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept)


def slice_bytes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id, th, all text bytes, starts) of a batch of keyed rows."""
    ids, ths = batch.column("id").to_numpy(), batch.column("th").to_numpy()
    return (ids, ths, *flat(batch.column("text")))
