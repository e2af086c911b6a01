"""SimHash, bit-sliced comparison, components, exact dedup."""

import random
import re
import tracemalloc

import numpy as np
import xxhash

from timelog.llm import bitslice, exact, setjoin, simhash
from timelog.llm.components import connected


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, linked):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    values = sorted(values)
    for n, a in enumerate(values):
        for b in values[n + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def plain_components(rows):
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    of = classes({f for _, f in fps}, lambda a, b: bin(a ^ b).count("1") <= 3)
    least = {}
    for i, f in fps:
        least[of[f]] = min(least.get(of[f], i), i)
    return sorted((i, f, least[of[f]]) for i, f in fps)


def got_components(df):
    return sorted((r.doc_id, r.fp % 2**64, r.component) for r in simhash.near_components(df).collect())


def test_real_documents(sample, sample_rows):
    assert got_components(sample) == plain_components(zip(sample_rows.doc_id.tolist(), sample_rows.text.tolist()))


def test_edges(documents):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two"), (7, "one  TWO"), (7, "one two"), (8, "é À b c"), (9, "a\x1fb c"), (10, "w " * 5000)]
    assert got_components(documents(rows, extra=True)) == plain_components(rows)
    assert simhash.near_components(documents([])).count() == 0


def test_one_of_each(documents):
    df = documents([(3, "a b c d"), (1, "A b c  d"), (2, "something else altogether here"), (1, "A b c  d")], extra=True)
    got = simhash.one_of_each(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [1, 2]


def test_near_lanes():
    rng = np.random.default_rng(0)
    lanes = rng.integers(0, 2**63, 64 * 3, np.int64).astype(np.uint64)
    for k in range(0, 192, 5):
        flips = rng.choice(64, rng.integers(0, 15), replace=False)
        lanes[k] = lanes[0] ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64)) if len(flips) else lanes[0]
    planes = simhash._planes(lanes)
    for radius in (0, 1, 2, 3, 5, 8, 12):
        queries = np.repeat(lanes[:20], 3)
        words = np.tile(np.arange(3), 20)
        row, lane = simhash.near_lanes(queries, planes[words], np.full(60, 2**64 - 1, np.uint64), radius)
        got = {(int(r) // 3, int(words[r]) * 64 + int(x)) for r, x in zip(row, lane)}
        assert got == {(q, x) for q in range(20) for x in range(192) if bin(int(lanes[q] ^ lanes[x])).count("1") <= radius}


def test_blocks_lose_no_link(spark):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    values = {centre}
    while len(values) < 150:
        values.add(rng.choice(sorted(values)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(12)))
    values |= {rng.getrandbits(64) for _ in range(50)}
    df = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp long")
    got = {r.node % 2**64: r.root % 2**64 for r in connected(simhash.near_links(df, block=16)).collect()}
    want = classes(values, lambda a, b: bin(a ^ b).count("1") <= 3)
    pairs = lambda m: {frozenset(v for v in values if m.get(v, v) == r) for r in {m.get(v, v) for v in values}}
    assert pairs(got) == pairs(want)


def test_components_of_chains(spark):
    edges = [(n, n + 1) for n in range(300)] + [(1000, n) for n in range(1001, 1100)] + [(5000, 5001), (5000, 5001)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: 0 for n in range(1, 301)} | {n: 1000 for n in range(1001, 1100)} | {5001: 5000}
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_exact_edges(documents):
    rows = [(5, "a b"), (4, "ab"), (3, "a  b"), (2, "x"), (1, None), (0, " \n"), (0, " \n"), (9, "A b"), (None, "q"), (None, "q"), (8, "q")]
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact.exact_dedup(documents(rows, extra=True)).collect())
    assert got == sorted([
        ("5", "3", 3, False), ("4", "3", 3, False), ("3", "3", 3, True), ("2", "2", 1, True), ("1", "0", 3, False), ("0", "0", 3, True), ("0", "0", 3, False), ("9", "9", 1, True),
        ("None", "8", 3, False), ("None", "8", 3, False), ("8", "8", 3, True),
    ])
    df = documents(rows, extra=True)
    kept = exact.drop_copies(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 8, 9]
    assert exact.exact_dedup(documents([])).count() == 0


def test_wide_near_copies(documents):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    rows, near = [], []
    for n in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(150, 400))]
        rows.append((n, " ".join(base)))
        edited = list(base)
        for k in rng.sample(range(len(base)), len(base) // 100):
            edited[k] = rng.choice(vocabulary)
        rows.append((1000 + n, " ".join(edited)))
        near.append(1000 + n)
    rows += [(5000 + n, " ".join(rng.choice(vocabulary) for _ in range(8))) for n in range(100)]
    kept = {r.doc_id for r in simhash.one_of_each(documents(rows, extra=True), wide=True).collect()}
    assert {i for i, _ in rows if i not in near} <= kept
    assert len(kept & set(near)) <= 3
    assert simhash.one_of_each(documents([]), wide=True).count() == 0


def plain_shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """The least id of each component of 3-bit links and links of Jaccard similarity 0.8 or more."""
    fp, own = {i: plain_fingerprint(t) for i, t in rows}, {i: plain_shingles(t) for i, t in rows}
    alike = lambda a, b: bool(own[a] and own[b]) and 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b])
    of = classes([i for i, _ in rows], lambda a, b: bin(fp[a] ^ fp[b]).count("1") <= 3 or alike(a, b))
    return set(of.values())


def edited(rng, words, times, vocabulary):
    out = list(words)
    for k in rng.sample(range(len(out)), times):
        out[k] = rng.choice(vocabulary)
    return out


def kept_ids(df):
    return {r.doc_id for r in simhash.one_of_each(df, wide=True).collect()}


def test_wide_links_are_exact(documents):
    """Pairs on both sides of 0.8, a hot group of near copies, chains, a passage that many documents share."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = []
    for _ in range(50):
        base = draw(rng.randrange(60, 150))
        texts += [base, edited(rng, base, rng.randrange(1, 6), vocabulary), base + draw(rng.randrange(5, 40))]
    hot = draw(100)
    texts += [edited(rng, hot, rng.randrange(4), vocabulary) for _ in range(60)]
    for _ in range(3):
        texts.append(hot)
        for _ in range(6):
            texts.append(edited(rng, texts[-1], 2, vocabulary))
    passage = draw(80)
    texts += [passage + draw(rng.randrange(10, 30)) for _ in range(40)]
    rng.shuffle(texts)
    rows = [(n, " ".join(t)) for n, t in enumerate(texts)]
    assert kept_ids(documents(rows, extra=True)) == plain_kept(rows)


def test_short_near_copies(documents):
    """Texts of under 20 words and their copies with a word more."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    texts = [[rng.choice(vocabulary) for _ in range(n)] for n in range(1, 20) for _ in range(2)]
    texts += [t + [rng.choice(vocabulary)] for t in texts] + [[], ["\t"], texts[8] * 2]
    rows = [(n, " ".join(t)) for n, t in enumerate(texts)]
    kept = kept_ids(documents(rows, extra=True))
    assert kept == plain_kept(rows) and not {38 + n for n in range(14, 38)} & kept


def test_planes_take_little_memory():
    """16 MB of bitmaps in lanes: planes of the same size, the same as word for word, without eight times as much meanwhile."""
    values = np.random.default_rng(4).integers(0, 2**63, (64 * 4000, 8)).astype(np.uint64)
    tracemalloc.start()
    planes = bitslice.planes_of(values)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    for word in (0, 255, 256, 3999):
        assert (planes[word] == bitslice.planes_of(values[64 * word : 64 * word + 64])[0]).all()


def test_possible_pairs_have_their_own_bound():
    """One token's sets, a few with far more room than others: just the pairs whose own sizes, room and bitmaps allow a link, so that unlike sets of a group make no rows."""
    rng = np.random.default_rng(5)
    base, fresh = rng.integers(0, 2**63, 140).astype(np.uint64), lambda k: rng.integers(0, 2**63, k).astype(np.uint64)
    # 300 sets that share most shingles but too few for a link, and 30 of near copies; of 146 shingles 6 to 14 are alone.
    sets = [np.concatenate([base[:122], fresh(18)]) for _ in range(300)] + [np.concatenate([base[k:], fresh(k)]) for k in range(30)]
    n, c = np.full(330, 146), np.array([132 + k % 4 for k in range(300)] + [140 + k % 7 for k in range(30)])
    label = np.arange(330) % 320
    bits = np.stack([setjoin.bitmap(s) for s in sets])
    pairs = setjoin.possible_pairs(np.zeros(330, np.int64), np.arange(330), label, n, c, bits, most=64)
    got = {(min(x), max(x)) for names, a, b in pairs for x in zip(names[a].tolist(), names[b].tolist())}
    room = setjoin.slack(n, c)
    far = np.bitwise_count(bits[:, None] ^ bits[None]).sum(axis=2, dtype=np.int64)
    want = {(a, b) for b in range(330) for a in range(b) if label[a] != label[b] and 0 <= room[a] + room[b] >= 9 * far[a, b]}
    assert got == want and 0 < len(want) < 330


def test_hot_bucket_stays_linear(spark, monkeypatch):
    """50,000 fingerprints that agree on all but 17 bits, and far ones: one component each, rows in proportion."""
    rng = np.random.default_rng(3)
    low = rng.choice(1 << 17, 50_000, replace=False).astype(np.int64)
    far = rng.integers(-(2**63), 2**63, 500)
    made = []
    refile = simhash._refile

    def counted(hot):
        out = refile(hot).cache()
        made.append((hot.count(), out.count()))
        return out

    monkeypatch.setattr(simhash, "_refile", counted)
    df = spark.createDataFrame([(int(v),) for v in np.concatenate([low + (0x1234 << 40), far])], "fp long")
    links = simhash.near_links(df)
    assert links.count() <= 30 * 50_000 and made and all(b == 4 * a for a, b in made) and sum(b for _, b in made) <= 40 * 50_000
    root = {r.node: r.root for r in connected(links).collect()}
    top = min(int(v) + (0x1234 << 40) for v in low)
    assert {root.get(int(v) + (0x1234 << 40), top) for v in low} == {top}
    assert not any(int(v) in root for v in far)


def test_quarters_cover_and_shrink():
    for mask in (*simhash.field_masks(), 0b1011, 1, 0):
        rest = ((1 << 64) - 1) & ~mask
        parts = simhash.quarters(rest)
        assert sum(parts) == rest and max(p.bit_count() for p in parts) - min(p.bit_count() for p in parts) <= 1


def test_one_of_each_with_repeated_ids(spark, documents):
    """Repeated and null ids with unlike texts lose no text; repeated rows are one."""
    a, b, c = ("alpha beta gamma delta epsilon", "one two three four five six", "completely other words in this text here")
    rows = [(0, a), (1, a), (1, b), (1, b), (None, c), (None, a), (None, b + " seven"), (2, None), (3, "")]
    for wide in (False, True):
        df = documents(rows, extra=True)
        got = simhash.one_of_each(df, wide=wide)
        assert got.columns == df.columns
        kept = sorted((str(r.doc_id), r.text) for r in got.collect())
        assert kept == sorted([("0", a), ("1", b), ("None", c), ("None", b + " seven"), ("2", None)]), wide
