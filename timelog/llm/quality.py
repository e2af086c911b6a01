"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into quantile bins; shallow boosted trees, one
feature at a time in turn, are summed into one lookup table per feature, and a
second round of two-feature trees into one table per chosen pair. A score is
the sum of the bins' table entries through a logistic link, added for many
texts at once.

Fitting takes a bounded sample of labelled rows (`FIT_ROWS`, by hash order);
everything else is one map pass without a shuffle over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timelog.llm.common import byte_slices, discard, stored, unnamed, utf8

#: Most labelled rows that a fit reads; beyond it, the first in hash order of the id.
FIT_ROWS = 20_000
FEATURES = (
    "log_bytes", "log_words", "word_len", "upper", "digit", "space", "newline", "comma_stop", "bang", "mark",
    "bracket", "high", "repeat_word", "short_word", "long_word", "line_len", "repeat_line", "top_word",
)

_KIND = np.zeros(256, np.int64)
for _n, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b",.;:", b"!?", b"*#$%&@^~_=+|\\/", b"()[]{}<>\"'`-"), 1):
    _KIND[list(_chars)] = _n
_KIND[128:] = 9


def text_features(text: bytes) -> list[float]:
    """The values of FEATURES; an empty text gives zeros."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    kinds = np.bincount(_KIND, np.bincount(np.frombuffer(text, np.uint8), minlength=256), 10) / n
    tokens = text.split()
    m = max(1, len(tokens))
    seen: dict[bytes, int] = {}
    for w in tokens:
        seen[w] = seen.get(w, 0) + 1
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) if tokens else np.zeros(1, np.int64)
    lines = [x for x in text.split(b"\n") if x]
    k = max(1, len(lines))
    return [
        np.log1p(n), np.log1p(len(tokens)), float(sizes.mean()), *kinds[1:9].tolist()[:8], float(kinds[9]),
        1 - len(seen) / m, float((sizes <= 3).mean()), float((sizes >= 12).mean()), np.log1p(n / k), 1 - len(set(lines)) / k, max(seen.values(), default=0) / m,
    ]


@dataclass
class Gam:
    """Lookup tables over binned features."""

    cuts: list[np.ndarray]
    base: float
    single: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    double: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.base)
        for j, table in enumerate(self.single):
            z += table[b[:, j]]
        for (i, j), table in zip(self.pairs, self.double):
            z += table[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return 1 / (1 + np.exp(-z))


def _leaf(g: np.ndarray, h: np.ndarray, ridge: float) -> float:
    return float(g.sum() / (h.sum() + ridge))


def _step(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """A tree of up to `leaves` leaves over one feature's bins, from gradient and curvature sums by bin."""
    edges = [0, len(g)]
    gs, hs = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (gs[b] - gs[a]) ** 2 / (hs[b] - hs[a] + ridge)
    while len(edges) <= leaves:
        best, where = 1e-9, None
        for a, b in zip(edges, edges[1:]):
            if b - a > 1:
                s = np.arange(a + 1, b)
                gains = gain(a, s) + gain(s, b) - gain(a, b)
                if gains.max() > best:
                    best, where = gains.max(), int(s[gains.argmax()])
        if where is None:
            break
        edges = sorted([*edges, where])
    out = np.zeros(len(g))
    for a, b in zip(edges, edges[1:]):
        out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + ridge)
    return out


def _cross(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """The best two-by-two tree over a pair's bins and its gain."""
    pad = lambda t: np.pad(t.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    G, H = pad(g), pad(h)
    best, cut = -1.0, (0, 0)
    for a in range(1, g.shape[0]):
        quads = lambda t: (t[a, 1:-1], t[a, -1] - t[a, 1:-1], t[-1, 1:-1] - t[a, 1:-1], t[-1, -1] - t[a, -1] - t[-1, 1:-1] + t[a, 1:-1])  # noqa: B023, E731
        gains = sum(x * x / (y + ridge) for x, y in zip(quads(G), quads(H)))
        if len(gains) and gains.max() > best:
            best, cut = float(gains.max()), (a, int(gains.argmax()) + 1)
    out = np.zeros(g.shape)
    a, b = cut
    for r in (slice(0, a), slice(a, None)):
        for c in (slice(0, b), slice(b, None)):
            if g[r, c].size:
                out[r, c] = _leaf(g[r, c], h[r, c], ridge)
    return out, best


def fit_gam(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 8, rate: float = 0.1, n_bins: int = 32, leaves: int = 3, ridge: float = 5.0) -> Gam:
    """Cyclic boosting: every round grows one small tree per feature, then per chosen pair. No or one-sided labels give a constant."""
    features = x.shape[1]
    if not len(y) or y.min() == y.max():
        mean = float(y.mean()) if len(y) else 0.5
        mean = min(max(mean, 0.01), 0.99)
        return Gam([np.zeros(0)] * features, float(np.log(mean / (1 - mean))), [np.zeros(1)] * features)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) for j in range(features)]
    model = Gam(cuts, float(np.log(y.mean() / (1 - y.mean()))), [np.zeros(len(c) + 1) for c in cuts])
    b = model.bins(x)
    z = np.full(len(y), model.base)
    for _ in range(rounds):
        for j in range(features):
            p = 1 / (1 + np.exp(-z))
            size = len(cuts[j]) + 1
            tree = rate * _step(np.bincount(b[:, j], y - p, size), np.bincount(b[:, j], p * (1 - p), size), leaves, ridge)
            model.single[j] += tree
            z += tree[b[:, j]]
    model.coarse = [np.arange(len(c) + 1) * 8 // (len(c) + 1) for c in cuts]
    wide = [int(c[-1]) + 1 for c in model.coarse]
    cell = lambda i, j: model.coarse[i][b[:, i]] * wide[j] + model.coarse[j][b[:, j]]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        at, n = cell(i, j), wide[i] * wide[j]
        return np.bincount(at, y - p, n).reshape(wide[i], wide[j]), np.bincount(at, p * (1 - p), n).reshape(wide[i], wide[j])

    ranked = sorted(((_cross(*sums(i, j), ridge)[1], i, j) for i in range(features) for j in range(i) if wide[i] > 1 and wide[j] > 1), reverse=True)
    model.pairs = [(i, j) for _, i, j in ranked[:n_pairs]]
    model.double = [np.zeros((wide[i], wide[j])) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(model.pairs):
            tree = rate * _cross(*sums(i, j), ridge)[0]
            model.double[k] += tree
            z += tree.reshape(-1)[cell(i, j)]
    return model


def labelled_features(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and 0/1 labels of at most `most` labelled rows, in hash order of the id; the labels table may hold null and repeated rows, and of documents that share an id the one of least text hash teaches."""
    some = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("y"))
    some = stored(some.orderBy(F.xxhash64("id"), "id").limit(most))
    texts = docs.select(F.col(id_col).alias("key"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")).join(some, F.col("key") == F.col("id")).select("id", "th", "y", "text")
    names = [f"f{j}" for j in range(len(FEATURES))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([text_features(t) for t in utf8(batch.column(3))]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), batch.column(2), *map(pa.array, x.T)], ["id", "th", "y", *names])

    seen = texts.mapInArrow(run, ", ".join(["id long, th long, y double", *(f"{n} double" for n in names)]))
    rows = sorted(seen.groupBy("id").agg(F.min_by(F.struct("y", *names), "th").alias("x")).select("id", "x.*").collect())
    discard(some)
    table = np.array(rows, float).reshape(-1, len(FEATURES) + 2)
    return table[:, 2:], table[:, 1]


def score_quality(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (the id by default) and score, 0 to 1; null counts as empty text."""
    keep = keep or [id_col]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "__text", 4 << 20):
                x = np.array([text_features(t) for t in utf8(batch.column("__text"))]).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(model.score(x))], [*keep, "score"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in keep]).schema]
    return source.mapInArrow(run, ", ".join([*kinds, "score double"]))


def keep_quality(docs: DataFrame, model: Gam, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows that score below `least`; columns as they were."""
    plain, back = unnamed(docs)
    scored = score_quality(plain, model, back[id_col], back[text_col], keep=plain.columns)
    return scored.where(F.col("score") >= least).select(*plain.columns).toDF(*docs.columns)


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Gam:
    """A model from the labelled rows outside the held-out fold."""
    x, y = labelled_features(docs, labels.where(~held_out(id_col)), id_col=id_col, text_col=text_col)
    return fit_gam(x, y)
