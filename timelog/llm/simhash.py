"""SimHash near-dedup with bit-sliced comparison.

Fingerprints: majority bits of the XXH64 of a text's word shingles. Distinct
fingerprints are split into five bit fields; two that differ in at most three
bits agree in two fields at least, so each is filed under its ten pairs of
fields and compared only inside those buckets. Buckets hold about n / 2**25
unrelated fingerprints. The members of a bucket above BLOCK are filed again
under the quarters of the bits that the bucket leaves open (of four quarters,
one has no differing bit), and so on until every bucket is small: no pair is
lost, no task gets a whole hot bucket, and rows stay linear in the input.

Inside a unit, distances are bit-sliced (see bitslice). A unit hands on a
spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timelog.llm import bitslice, setjoin
from timelog.llm.bitslice import planes_of
from timelog.llm.common import byte_slices, discard, stored, unnamed, utf8
from timelog.llm.components import connected

RADIUS = 3
FIELDS = (13, 13, 13, 13, 12)
BLOCK = 4096
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Bit b is set if over half of the shingles' hashes have it; a text without words gives 0."""
    tokens = text.translate(_FOLD).split(b" ")
    tokens = [w for w in tokens if w]
    if not tokens:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= shingle:
        hashes = [digest(b" ".join(tokens), seed)]
    else:
        joined = b" ".join(tokens)
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
        starts = np.concatenate([[0], ends[:-1]])[: len(tokens) - shingle + 1].tolist()
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sets: bool = False) -> DataFrame:
    """(id, th, fp): a 64-bit hash of a row's text, and its fingerprint as a signed long; with `sets` also sig, the name of its set of five-word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text", 4 << 20):
                texts = utf8(batch.column("text"))
                cols = [batch.column("id"), batch.column("th"), _signed(np.array([fingerprint(t) for t in texts], np.uint64))]
                if sets:
                    cols.append(pa.array([setjoin.signature(setjoin.shingles(t)) for t in texts], pa.int64()))
                yield pa.RecordBatch.from_arrays(cols, ["id", "th", "fp", "sig"][: len(cols)])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, th long, fp long" + ", sig long" * sets)


def _planes(values: np.ndarray) -> np.ndarray:
    return planes_of(values)


def near_lanes(queries: np.ndarray, planes: np.ndarray, valid: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Bit-sliced distances of queries[i] to the 64 lanes of planes[i]: (i, lane) within the radius."""
    return bitslice.near_lanes(queries, planes, np.arange(len(queries)), valid, radius)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least vertex that each of 0..n-1 reaches over the edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, nxt := new[new]):
            new = nxt
        if np.array_equal(new, label):
            return label
        label = new


def unit_links(unit: np.ndarray, fp: np.ndarray, radius: int = RADIUS, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of the links inside each unit: at most one per fingerprint."""
    if not len(fp):
        return fp, fp
    order = np.lexsort((fp, unit))
    unit, fp = unit[order], fp[order]
    lanes = bitslice.Lanes(unit, fp)
    a_all, b_all = np.zeros(0, int), np.zeros(0, int)
    # A member meets the words from its own on.
    for q, word in lanes.stretches(lanes.end, most):
        row, lane = bitslice.near_lanes(fp[q], lanes.planes, word, lanes.valid[word], radius)
        a, b = q[row], lanes.index[word[row] * 64 + lane]
        keep = fp[a] != fp[b]
        if keep.any():
            label = _forest(len(fp), np.concatenate([a_all, a[keep]]), np.concatenate([b_all, b[keep]]))
            b_all = np.flatnonzero(label != np.arange(len(fp)))
            a_all = label[b_all]
    return fp[a_all], fp[b_all]


def field_masks() -> list[int]:
    """The bits of each of the ten pairs of fields: fingerprints within RADIUS bits agree on all bits of one pair at least."""
    ends = np.cumsum(FIELDS)
    fields = [((1 << int(end)) - 1) ^ ((1 << int(end) - width) - 1) for end, width in zip(ends, FIELDS)]
    return [a | b for a, b in combinations(fields, 2)]


def quarters(mask: int, parts: int = RADIUS + 1) -> list[int]:
    """The bits of `mask` dealt to `parts` masks as evenly as may be: fingerprints that differ in at most RADIUS bits of `mask` agree on all bits of one part."""
    bits = [k for k in range(64) if mask >> k & 1]
    return [sum(1 << k for k in bits[n::parts]) for n in range(parts)]


def _long(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _refile(hot: DataFrame) -> DataFrame:
    """Each (fp, key, rest) under four keys of its own bucket, one per quarter of the bits `rest` that the bucket leaves open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, key, rest = (batch.column(c).to_numpy().view(np.uint64) for c in ("fp", "key", "rest"))
            for mask in np.unique(rest).tolist():
                own, at = fp[rest == mask], key[rest == mask]
                for n, part in enumerate(quarters(mask)):
                    # Two rounds of a multiplicative hash: keys of unlike buckets or bits meet by chance only, and chance does no harm.
                    new = (at ^ (own & np.uint64(part)) * _MIX) + np.uint64(n)
                    new = (new ^ (new >> np.uint64(31))) * _MIX
                    yield pa.RecordBatch.from_arrays([_signed(own), _signed(new), _signed(np.full(len(own), mask & ~part, np.uint64))], ["fp", "key", "rest"])

    return hot.select("fp", "key", "rest").mapInArrow(run, "fp long, key long, rest long")


def near_links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """(fp) distinct fingerprints -> (u, v) links that connect what pairs within RADIUS bits connect.

    Every pass files a fingerprint ten times, or four times if its bucket was
    too large, so rows grow in proportion to the input at any group size. The
    bits that a bucket leaves open shrink by a quarter each time, and 2**bits
    distinct fingerprints are the most that it can hold, so the passes end.
    """
    few = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = (1 << 64) - 1
    at = [F.struct(F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(F.lit(_long(m)))).alias("key"), F.lit(_long(rest & ~m)).alias("rest")) for n, m in enumerate(field_masks())]
    filed = distinct.select("fp", F.inline(F.array(*at)))
    units, spent = [], []
    while filed is not None:
        sizes = stored(filed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
        units.append(filed.join(sizes.where(F.col("n") <= block), "key", "left_semi").select(F.col("key").alias("unit"), "fp"))
        hot = sizes.where(F.col("n") > block)
        spent.append(sizes)
        filed = None if hot.isEmpty() else stored(_refile(filed.join(hot, "key", "left_semi")))
        spent += [filed] if filed is not None else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def links(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
            unit, fp = (np.concatenate([b.column(c).to_numpy() for b in tables]) for c in range(2))
            a, b = unit_links(unit, fp.view(np.uint64))
            return pa.RecordBatch.from_arrays([_signed(a), _signed(b)], ["a", "b"])

        # Sorted by unit: a piece ends where a unit ends.
        for batch in batches:
            unit = batch.column(0).to_numpy()
            if held and rows >= 1 << 17:
                last = held[-1].column(0)[-1].as_py()
                if unit[0] != last or unit[-1] != last:
                    cut = int(np.argmax(unit != last)) if unit[0] == last else 0
                    held.append(batch.slice(0, cut))
                    yield links([b for b in held if b.num_rows])
                    held, rows, batch = [], 0, batch.slice(cut)
            held.append(batch)
            rows += batch.num_rows
        if held:
            yield links(held)

    dealt = reduce(DataFrame.unionByName, units).repartition(few, "unit").sortWithinPartitions("unit")
    found = stored(dealt.mapInArrow(run, "a long, b long").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")))
    discard(*spent)
    return found


def _linked(docs: DataFrame, id_col: str, text_col: str, wide: bool) -> tuple[DataFrame, DataFrame]:
    """Stored (id, th, fp) of all rows, and (node, root) of the fingerprints that have links."""
    rows = stored(fingerprints(docs, id_col, text_col, wide))
    distinct = rows.select("fp").distinct()
    if not wide:
        links = near_links(distinct)
        roots = connected(links)
        discard(links)
        return rows, roots
    pairs = stored(rows.where("sig is not null").select("fp", "sig").distinct())
    # Each shingle set stands for its least fingerprint, and ties its others to it.
    least = stored(pairs.groupBy("sig").agg(F.min("fp").alias("rep")))
    tied = pairs.join(least, "sig").where("fp <> rep").select(F.col("rep").alias("u"), F.col("fp").alias("v"))
    found: list[DataFrame] = []

    def roots_of(links: DataFrame | None) -> DataFrame:
        near = near_links(distinct) if links is None else None
        edges = near.unionByName(tied) if near is not None else found[-1].select(F.col("root").alias("u"), F.col("node").alias("v")).unionByName(links)
        found.append(connected(edges))
        discard(*([near] if near is not None else found[-2:-1]))
        return found[-1]

    roots = setjoin.joined_roots(docs, text_col, least, roots_of)
    discard(pairs, least)
    return rows.select("id", "th", "fp"), roots


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wide: bool = False) -> DataFrame:
    """One row per row of `docs`: id, fp (signed long), component (least id reachable by links of at most 3 bits).

    `wide` also links texts whose sets of five-word shingles have a Jaccard
    similarity of 0.8 or more; both kinds of links are complete (see setjoin).
    Null and empty texts have fingerprint 0 and link like any other. Rows with
    equal fingerprints are one vertex, so copies of any number cost one row.
    Ids are taken as they are; a null id is never a component's least id unless
    all are null. An empty table gives an empty result; no other column is read.
    """
    rows, roots = _linked(docs, id_col, text_col, wide)
    distinct = rows.groupBy("fp").agg(F.min("id").alias("low"))
    placed = stored(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root")))
    # Read from files on both sides of the join, so that a root of many fingerprints can be split.
    least = stored(placed.groupBy("root").agg(F.min("low").alias("component")))
    discard(roots)
    named = placed.join(least, "root").select(F.col("fp").alias("f"), "component")
    return rows.join(named, F.col("fp") == F.col("f")).select(F.col("id").alias(id_col), "fp", "component")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`components` by fingerprints alone."""
    return components(docs, id_col, text_col)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wide: bool = False) -> DataFrame:
    """`docs` with one row of each component only: the least id (null last), of repeated ids the least hash of the text.

    Rows that agree in id and text are one row. Ids may repeat or be null with
    unlike texts: rows are told apart by both. Other columns may have any name.
    """
    plain, back = unnamed(docs)
    id_, text = back[id_col], back[text_col]
    rows, roots = _linked(plain, id_, text, wide)
    counted = rows.groupBy("id", "th", "fp").agg(F.count("*").alias("n"))
    placed = counted.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    first = F.min(F.struct(F.col("id").isNull().alias("void"), "id", "th", "n")).alias("x")
    keep = stored(placed.groupBy("root").agg(first).select(F.col("x.id").alias("__id"), F.col("x.th").alias("__keep"), "x.n"))
    discard(roots)
    marked = plain.withColumn("__th", F.xxhash64(text))
    same = F.col(id_).eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__keep"))
    out = marked.join(keep.where("n = 1"), same, "left_semi")
    again = keep.where("n > 1")
    if not again.isEmpty():
        out = out.unionByName(marked.join(again, same, "left_semi").dropDuplicates([id_, "__th"]))
    return out.select(*plain.columns).toDF(*docs.columns)
