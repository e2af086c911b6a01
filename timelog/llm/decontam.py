"""Benchmark decontamination with a generalised suffix automaton.

Benchmark items are normalised to words and put into one automaton per shard
of items; training texts stream through it word by word while the longest
match ending at each word is tracked. A match of at least `window` words marks
the last `window` words; a whole item of fewer words marks itself.

The items are the stated query set, held against all texts in one map pass
without a shuffle. Items are read in order of id in shards of at most
SHARD_BYTES of text, so what is broadcast has a fixed bound: about 30 times
that in each Python worker. A benchmark of several shards is several map passes
whose hits are merged by position.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelog.llm.common import byte_slices, unnamed, utf8

#: Benchmark text of one automaton.
SHARD_BYTES = 4 << 20
#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton over the words of several items.

    Built with a dict per state, and kept and sent as flat arrays: the first
    transition, link and length of every state, the set of items that hold its
    window, and the other transitions by state * vocabulary + word, which become
    one dict of integers where the automaton is used.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        numbered = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in tokens]) for name, tokens in items]
        build = _Builder()
        for _, tokens in numbered:
            last = 0
            for w in tokens:
                last = build.extend(last, w)
        size = max(1, len(self.vocabulary))
        self.link, self.len = array("i", build.link), array("i", build.len)
        order = sorted(range(len(build.len)), key=build.len.__getitem__)
        # The state on the suffix path that holds the string of `window` words.
        self.gram = array("i", [0]) * len(order)
        for s in order:
            up = self.link[s]
            self.gram[s] = 0 if self.len[s] < window else s if self.len[up] < window else self.gram[up]
        holders: dict[int, set[str]] = {}
        own: dict[int, list[tuple[int, str | None]]] = {}
        for name, tokens in numbered:
            s = 0
            for n, w in enumerate(tokens, 1):
                s = build.next[s][w]
                if n >= window:
                    holders.setdefault(self.gram[s], set()).update([name] if name is not None else [])
            if 0 < len(tokens) < window:
                own.setdefault(s, []).append((len(tokens), name))
        # Whole short items that end wherever a state's strings end, longest first.
        self.whole: dict[int, list[tuple[int, str | None]]] = {}
        for s in order[1:] if own else ():
            found = own.get(s, []) + self.whole.get(self.link[s], [])
            if found:
                self.whole[s] = found
        # Windows with the same holders share one tuple.
        sets: dict[tuple[str, ...], int] = {}
        self.held = array("i", [-1]) * len(order)
        for s, names in holders.items():
            self.held[s] = sets.setdefault(tuple(sorted(names)), len(sets))
        self.sets = list(sets)
        self.word, self.to = array("i", [-1]) * len(order), array("i", [0]) * len(order)
        self.keys, self.targets = array("q"), array("i")
        for s, to in enumerate(build.next):
            for k, (w, t) in enumerate(to.items()):
                if k:
                    self.keys.append(s * size + w)
                    self.targets.append(t)
                else:
                    self.word[s], self.to[s] = w, t
        self._open()

    def _open(self) -> None:
        self.step = dict(zip(self.keys, self.targets))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "step"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._open()

    def scan(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Hit spans of words (start, end), the items with hits, the longest match."""
        step, first, to, link, length, whole, window = self.step, self.word, self.to, self.link, self.len, self.whole, self.window
        gram, held, size = self.gram, self.held, max(1, len(self.vocabulary))
        seen: set[int] = set()
        s = n = longest = 0
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        for i, w in enumerate(map(self.vocabulary.get, tokens)):
            if w is None:
                s = n = 0
                continue
            t = to[s] if first[s] == w else step.get(s * size + w)
            if t is None:
                while s:
                    s = link[s]
                    t = to[s] if first[s] == w else step.get(s * size + w)
                    if t is not None:
                        break
                if t is None:
                    n = 0
                    continue
                n = length[s]
            s = t
            n += 1
            if n > longest:
                longest = n
            if n >= window:
                spans.append((i + 1 - window, i + 1))
                seen.add(held[gram[s]])
            if s in whole:
                for m, name in whole[s]:
                    if m <= n:
                        spans.append((i + 1 - m, i + 1))
                        if name is not None:
                            found.add(name)
        for k in seen:
            found.update(self.sets[k])
        return spans, found, longest


class _Builder:
    """The automaton while it grows."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]

    def _split(self, p: int, w: int, q: int) -> int:
        clone = len(self.len)
        self.len.append(self.len[p] + 1)
        self.next.append(self.next[q].copy())
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, w, q)
        new = len(self.len)
        self.len.append(self.len[last] + 1)
        self.next.append({})
        self.link.append(0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, w, q)
        return new


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _shards(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text is not null").orderBy("item", "text")
    shard, size = [], 0
    for item, text in rows.toLocalIterator():
        data = text.encode()
        if shard and size + len(data) > SHARD_BYTES:
            yield shard
            shard, size = [], 0
        shard.append((item, words(data)))
        size += len(data)
    if shard:
        yield shard


HITS = "n_words long, longest long, spans array<array<int>>, items array<string>"


def _pass(docs: DataFrame, shard: list[tuple[str | None, list[bytes]]], window: int, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(Automaton(shard, window))
    arrow = pa.schema([("n_words", pa.int64()), ("longest", pa.int64()), ("spans", pa.list_(pa.list_(pa.int32()))), ("items", pa.list_(pa.string()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = sent.value
        for whole in batches:
            for batch in byte_slices(whole, "__text", 4 << 20):
                rows = []
                for text in utf8(batch.column("__text")):
                    tokens = words(text)
                    spans, items, longest = automaton.scan(tokens)
                    rows.append((len(tokens), longest, merged(spans), sorted(items)))
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)]
                kept = [batch.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, *cols], [*keep, *arrow.names])

    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("__text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*[F.col(f"`{c}`") for c in keep]).schema]
    return source.mapInArrow(scan, ", ".join([*kinds, HITS]))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row of `docs`: the columns `keep` (the id by default), n_words, longest (match in words), spans (hit word ranges), items.

    Null and empty texts have no words and no hits; items without words match
    nothing; items with equal texts or ids both count (ids once per document).
    An item without an id makes hits and spans but stands in no list of items.
    An empty benchmark leaves every document without hits. With a benchmark of
    several shards, rows are told apart by id and text hash.
    """
    keep = keep or [id_col]
    shards = list(_shards(benchmark, item_col, item_text_col)) or [[]]
    if len(shards) == 1:
        return _pass(docs, shards[0], window, id_col, text_col, keep)
    key = docs.withColumn("__key", F.xxhash64(F.col(id_col), F.col(text_col)))
    one = _pass(key, shards[0], window, id_col, text_col, [*keep, "__key"])
    # The other shards give narrow rows, which meet by document once.
    rest = [_pass(key, shard, window, id_col, text_col, ["__key"]).drop("n_words").dropDuplicates(["__key"]) for shard in shards[1:]]
    found = reduce(DataFrame.unionByName, rest).groupBy("__key")
    found = found.agg(F.max("longest").alias("l2"), F.flatten(F.collect_list("spans")).alias("s2"), F.flatten(F.collect_list("items")).alias("i2"))
    one = one.join(found, "__key").select(
        *keep, "n_words", F.greatest("longest", "l2").alias("longest"), F.concat("spans", "s2").alias("spans"), F.array_sort(F.array_union("items", "i2")).alias("items")
    )
    union = F.aggregate(
        F.array_sort("spans"),
        F.array().cast("array<array<int>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(F.element_at(acc, -1), 2) >= s[0]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.array(F.element_at(acc, -1)[0], F.greatest(F.element_at(F.element_at(acc, -1), 2), s[1])))),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    return one.withColumn("spans", union)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_words: int | None = 0, max_coverage: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the documents in which a hit span is longer than `max_words` or hit words exceed `max_coverage`.

    max_words=0 drops every document with a hit, None sets no limit on spans.
    Columns and rows are otherwise as they were; null texts stay.
    """
    plain, back = unnamed(docs)
    hits = benchmark_hits(plain, benchmark, window, back[id_col], back[text_col], keep=plain.columns)
    size = F.transform("spans", lambda s: s[1] - s[0])
    hit = F.aggregate(size, F.lit(0), lambda a, b: a + b)
    bad = hit > F.col("n_words") * max_coverage
    if max_words is not None:
        bad = bad | F.exists(size, lambda n: n > max_words)
    return hits.where(~bad).select(*plain.columns).toDF(*docs.columns)


def without_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_words: int = 0, max_coverage: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the hit spans of more than `max_words` words cut out of their texts; documents of which hits cover more than `max_coverage` of the words go.

    What stands between kept words stays as it is. Null texts stay null, other
    columns and rows are as they were.
    """
    plain, back = unnamed(docs)
    text, names = back[text_col], plain.columns
    hits = benchmark_hits(plain, benchmark, window, back[id_col], text, keep=names)
    hit = F.aggregate(F.transform("spans", lambda s: s[1] - s[0]), F.lit(0), lambda a, b: a + b)
    rows = hits.where(hit <= F.col("n_words") * max_coverage).select(*names, F.filter("spans", lambda s: s[1] - s[0] > max_words).alias("__cut"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [remove_spans(t, cut) if cut else t for t, cut in zip(batch.column(text).to_pylist(), batch.column("__cut").to_pylist())]
            kind = batch.schema.field(text).type
            yield pa.RecordBatch.from_arrays([pa.array(texts, kind) if c == text else batch.column(c) for c in names], names)

    return rows.mapInArrow(run, plain.schema).toDF(*docs.columns)


def remove_spans(text: str, spans: list[list[int]]) -> str:
    """`text` without the words in `spans`, as benchmark_hits numbers them; what stands between kept words stays."""
    data = text.encode()
    folded = np.frombuffer(data.translate(_FOLD), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[False], folded, [False]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    keep = np.ones(len(data), bool)
    for a, b in spans:
        keep[begin[a] : end[b - 1]] = False
    return np.frombuffer(data, np.uint8)[keep].tobytes().decode()


def items_digest(items: Column) -> Column:
    return F.sha2(F.concat_ws(",", items), 256)
