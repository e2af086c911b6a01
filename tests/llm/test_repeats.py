"""Suffix-array and chunk dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest

from timelog.llm import chunking, suffix
from timelog.llm.packed import joined_spans


def plain_repeats(rows, length):
    """doc index -> mask of bytes covered by a `length`-byte string of a smaller doc_id."""
    least = {}
    texts = [(n, i, (t or "").encode()) for n, (i, t) in enumerate(rows)]
    for _, i, t in texts:
        for k in range(len(t) - length + 1):
            g = t[k : k + length]
            least[g] = min(least.get(g, i), i)
    out = {}
    for n, i, t in texts:
        mask = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if least[t[k : k + length]] < i:
                mask[k : k + length] = True
        out[n] = mask
    return out


def described(text, mask):
    data = np.frombuffer((text or "").encode(), np.uint8)
    runs = int((np.diff(np.concatenate([[0], mask.astype(np.int8)])) == 1).sum())
    return len(data), int(mask.sum()), runs, hashlib.sha256(data[~mask].tobytes()).hexdigest()


def check(df, rows, length=50):
    got = sorted(tuple(r)[:5] for r in suffix.remove_repeats(df, length).collect())
    masks = plain_repeats(rows, length)
    assert got == sorted((i, *described(t, masks[n])) for n, (i, t) in enumerate(rows))


def test_real_documents(sample, sample_rows):
    check(sample, list(zip(sample_rows.doc_id.tolist(), sample_rows.text.tolist())))


def test_edges(documents):
    passage = "In the beginning there was a long passage that many documents share, word for word. "
    rows = [(1, None), (2, ""), (3, "x" * 200), (4, "x" * 49), (5, "x" * 120), (6, passage), (7, "Pre " + passage * 3), (7, "Pre " + passage * 3), (8, "é" * 60), (9, "ab" + "é" * 40), (10, passage[:50]), (11, passage[:49]), (12, "\x00" * 60 + passage), (13, "\x00" * 70)]
    check(documents(rows, extra=True), rows)


def test_random_overlaps(documents):
    rng = random.Random(1)
    parts = ["".join(rng.choice("abc ") for _ in range(rng.randrange(20, 90))) for _ in range(12)]
    rows = [(n, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 9)))) for n in rng.sample(range(100), 40)]
    check(documents(rows), rows)


def test_empty_table(documents):
    assert suffix.remove_repeats(documents([])).count() == 0
    assert chunking.chunk_dedup(documents([])).count() == 0


@pytest.mark.parametrize("length", [2, 5])
def test_interval_expansion(length):
    rng = np.random.default_rng(length)
    for _ in range(30):
        n, width = rng.integers(1, 30), int(rng.integers(length + 1, 14))
        rows = rng.integers(0, 3, (n, width)).astype(np.uint8)
        lead, tail, owner = rng.integers(0, 2, n), rng.integers(0, 2, n), rng.integers(0, 9, n)
        got = suffix.window_owners(rows, lead, tail, owner, length)
        spots = [(i, t) for i in range(n) for t in range(width - length + 1) if t >= lead[i] and t + length <= width - tail[i]]
        least = {}
        for i, t in spots:
            g = rows[i, t : t + length].tobytes()
            least[g] = min(least.get(g, 99), owner[i])
        for i, t in spots:
            assert got[i, t] == least[rows[i, t : t + length].tobytes()]


def test_every_window_has_one_anchor():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    data[500:700] = 97
    starts = np.array([0, 40, 90, 140, 900, 3000])
    p, h, first, last = suffix.anchors(data, starts)
    owned = sorted(w for a, b in zip(first, last) for w in range(a, b + 1))
    assert owned == [w for a, b in zip(starts, starts[1:]) for w in range(a, b - 49)]


def test_joined_spans():
    pairs = np.array([[5, 9], [0, 3], [8, 12], [3, 4], [20, 21]], np.int64)
    assert joined_spans([pairs.tobytes()]).tolist() == [[0, 4], [5, 12], [20, 21]]
    assert len(joined_spans(None)) == 0


def plain_chunks(text, table):
    h, last, out = 0, 0, []
    for k, c in enumerate(text):
        h = ((h << 1) + int(table[c])) & 0xFFFFFFFF
        end = k + 1
        if end - last == chunking.MOST or (h >> (32 - chunking.MASK_BITS) == 0 and end >= 32 and end - last >= chunking.LEAST and end < len(text)):
            out.append((last, end))
            last = end
    return out + [(last, len(text))] * (last < len(text))


def plain_chunk_dedup(rows, least_run):
    table, seen, out = chunking.gear_table(), set(), []
    for i, t in sorted(rows, key=lambda r: r[0]):
        text = (t or "").encode()
        mask = np.zeros(len(text), np.int8)
        for a, b in plain_chunks(text, table):
            mask[a:b] = text[a:b] in seen
            seen.add(text[a:b])
        runs = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]]))).reshape(-1, 2)
        for a, b in runs:
            mask[a:b] = b - a >= least_run
        out.append((i, *described(t, mask.astype(bool))))
    return sorted(out)


def test_chunks(sample, sample_rows):
    rows = list(zip(sample_rows.doc_id.tolist(), sample_rows.text.tolist()))
    assert sorted(tuple(r) for r in chunking.chunk_dedup(sample).collect()) == plain_chunk_dedup(rows, chunking.LEAST_RUN)


def test_chunk_edges_and_shifts(documents):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = [(1, long), (2, "inserted " + long), (3, None), (4, ""), (5, "tiny"), (6, "tiny"), (7, "z" * 1000)]
    got = sorted(tuple(r) for r in chunking.chunk_dedup(documents(rows, extra=True)).collect())
    assert got == plain_chunk_dedup(rows, chunking.LEAST_RUN)
    assert dict((r[0], r[2]) for r in got)[2] > 2700


def test_query_removes_short_copies(spark, documents, tmp_path):
    """Equal documents of a few bytes, a repeated line: the query leaves no repeated chunk."""
    from timelog.llm.queries import QUERIES

    rng = random.Random(3)
    line = "".join(rng.choice("abcdefgh ") for _ in range(100))
    rows = [(1, "tiny"), (2, "tiny"), (3, line), (4, line), (5, "".join(rng.choice("ijkl ") for _ in range(400)) + line)]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES["op9_chunk_dedup"](spark, str(tmp_path)).collect())
    assert got == plain_chunk_dedup(rows, 0)
    assert all(r[1] == r[2] for r in got if r[0] in (2, 4))


def test_hot_anchor_is_dealt_out():
    """Contexts of one anchor in small pieces lose no shared window, on either side of the anchor."""
    rng = np.random.default_rng(5)
    width, reach = 84, 34
    rows = rng.integers(97, 100, (400, width), dtype=np.uint8)
    rows[:, reach : reach + suffix.GRAM] = rows[0, reach : reach + suffix.GRAM]
    for k in range(0, 400, 4):
        # Three of four take a window from the context before, from far left to far right.
        for j in range(1, 4):
            t = int(rng.integers(0, reach + 1))
            rows[k + j, t : t + suffix.LENGTH] = rows[k, t : t + suffix.LENGTH]
    rows[300:] = rng.integers(97, 123, (100, width), dtype=np.uint8)
    zero, owner = np.zeros(400, int), rng.permutation(400)
    want = suffix.window_owners(rows, zero, zero, owner)
    got = np.full_like(want, suffix.NO_ID)
    sizes = []
    for piece in suffix.anchor_pieces(rows, reach, most=16):
        sizes.append(len(piece))
        got[piece] = np.minimum(got[piece], suffix.window_owners(rows[piece], zero[piece], zero[piece], owner[piece]))
    assert (got == want).all() and max(sizes) < 100 and (want < owner[:, None]).any(axis=1).sum() > 150
