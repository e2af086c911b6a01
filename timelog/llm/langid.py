"""Language identification by nearest centroid.

Texts become hashed character n-gram counts (one to three letters, other
characters as word breaks), weighted by sublinear TF-IDF and normalised. Each
language has several centroids from spherical k-means; a text gets the language
of the nearest centroid by cosine, and is rejected if it is further from it
than nearly all of that language's own training texts.

Fitting takes a bounded sample of labelled rows, an equal share for each
language (`FIT_ROWS` in all, `LEAST_PER_LANG` for each at least, by hash order
of the id); predicting is one map pass over whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timelog.llm.common import byte_slices, discard, stored

#: Labelled rows that a fit reads, dealt evenly to the languages; of each language the first in hash order of the id.
FIT_ROWS = 6_000
#: A language's share if there are so many languages that an even one would be smaller.
LEAST_PER_LANG = 50
BITS = 12
SHARPNESS = 20.0
UNKNOWN = "und"
_TABLE = 0x110000


@cache
def letter_table() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(_TABLE)), bool, _TABLE)


def gram_counts(text: str | None, letters: np.ndarray) -> tuple[np.ndarray, bool]:
    """Counts of the hashed 1- to 3-grams of a text's letters, and whether it has a letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.zeros(1 << BITS, np.float32)
    any_letter = False
    for at in range(0, len(points), 1 << 20):  # pieces overlap, so no n-gram is lost
        p = points[max(0, at - 2) : at + (1 << 20)]
        is_letter = letters[p]
        any_letter = any_letter or bool(is_letter.any())
        a = np.where(is_letter, p, np.uint32(32))
        a = np.concatenate([[np.uint32(32)], a, [np.uint32(32)]]) if not at else np.append(a, np.uint32(32))
        one = a[2:] * np.uint32(0x9E3779B1)
        two = one + a[1:-1] * np.uint32(0x85EBCA6B)
        three = two + a[:-2] * np.uint32(0xC2B2AE35)
        blank = (a[2:] == 32) & (a[1:-1] == 32)
        for salt, h in enumerate((one, two, three)):
            h = (h + np.uint32(salt * 0x27D4EB2F))[~blank]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            counts += np.bincount(h >> np.uint32(32 - BITS), minlength=1 << BITS).astype(np.float32)
    return counts, any_letter


@dataclass
class Centroids:
    langs: list[str]
    owner: np.ndarray
    points: np.ndarray
    idf: np.ndarray
    limit: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, score and whether it is rejected, for each row of counts."""
        near = self.vectors(counts) @ self.points.T
        by_lang = np.stack([near[:, self.owner == k].max(axis=1) for k in range(len(self.langs))], 1)
        best = by_lang.argmax(axis=1)
        top = by_lang[np.arange(len(best)), best]
        score = 1 / np.exp(SHARPNESS * (by_lang - top[:, None])).sum(axis=1)
        return best, score, top < self.limit[best]


def _spherical_kmeans(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Up to k unit centroids; the start is the mean direction, then the points furthest from those chosen."""
    seeds = [v.mean(axis=0)]
    near = v @ seeds[0]
    while len(seeds) < min(k, len(v)):
        seeds.append(v[near.argmin()])
        near = np.maximum(near, v @ seeds[-1])
    c = np.stack(seeds)
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = v[own == j].mean(axis=0)
                c[j] = m / max(np.linalg.norm(m), 1e-9)
    return c


def fit_centroids(counts: np.ndarray, langs: list[str], per_lang: int = 3, reject: float = 0.005) -> Centroids | None:
    """None without training rows."""
    if not len(langs):
        return None
    names = sorted(set(langs))
    idf = np.log((1 + len(langs)) / (1 + (counts > 0).sum(axis=0))) + 1
    model = Centroids(names, np.zeros(0, int), np.zeros((0, counts.shape[1])), idf.astype(np.float32), np.zeros(len(names)))
    v = model.vectors(counts)
    y = np.array([names.index(x) for x in langs])
    parts = [_spherical_kmeans(v[y == k], per_lang) for k in range(len(names))]
    model.points = np.concatenate(parts).astype(np.float32)
    model.owner = np.concatenate([np.full(len(p), k) for k, p in enumerate(parts)])
    model.limit = np.array([np.quantile((v[y == k] @ p.T).max(axis=1), reject) for k, p in enumerate(parts)])
    return model


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = FIT_ROWS, least: int = LEAST_PER_LANG) -> Centroids | None:
    """Centroids from labelled rows outside the held-out fold; rows without id, language or letters teach nothing. Of rows that share id and language, the one of least text hash teaches."""
    labelled = docs.select(F.col(id_col).alias("own"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    labelled = labelled.where(F.col("own").isNotNull() & F.col("lang").isNotNull() & ~held_out("own") & F.col("text").rlike("\\p{L}"))
    keys = labelled.groupBy("own", "lang").agg(F.min(F.xxhash64("text")).alias("th"))
    nth = Window.partitionBy("lang").orderBy(F.xxhash64("own"), "own")
    # Ids alone travel here, and no more than `most` of a language from each task.
    ranked = stored(keys.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= most))
    share = max(least, most // max(1, ranked.where("nth = 1").count()))
    some = ranked.where(F.col("nth") <= share).select(F.col("own").alias("k1"), F.col("lang").alias("k2"), F.col("th").alias("k3"))
    same = (F.col("own") == F.col("k1")) & (F.col("lang") == F.col("k2")) & (F.xxhash64("text") == F.col("k3"))
    rows = labelled.join(some, same, "left_semi").select(F.col("own").cast("string").alias("id"), "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for batch in batches:
            vectors = []
            for text in batch.column(2).to_pylist():
                counts, found = gram_counts(text, letters)
                at = np.flatnonzero(counts)
                vectors.append(at.astype(np.uint16).tobytes() + counts[at].tobytes() if found else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vectors, pa.binary())], ["id", "lang", "v"])

    found = rows.mapInArrow(run, "id string, lang string, v binary").where("v is not null").groupBy("id", "lang").agg(F.min("v").alias("v")).collect()
    discard(ranked)
    found.sort(key=lambda r: (r["id"], r["lang"], bytes(r["v"])))
    counts = np.zeros((len(found), 1 << BITS), np.float32)
    for n, r in enumerate(found):
        size = len(r["v"]) // 6
        counts[n, np.frombuffer(r["v"], np.uint16, size)] = np.frombuffer(bytes(r["v"])[2 * size :], np.float32)
    return fit_centroids(counts, [r["lang"] for r in found])


def predict(docs: DataFrame, model: Centroids | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (the id by default), lang_pred, score, rejected.

    Null texts, texts without a letter, and every text when nothing was learned
    get `und`, score 0 and rejected = true. Otherwise lang_pred is the nearest
    language; rejected says that the text is further off than the limit.
    """
    keep = keep or [id_col]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for whole in batches:
            for part in byte_slices(whole, "__text", 2 << 20):
                for at in range(0, part.num_rows, 256):
                    batch = part.slice(at, 256)
                    pairs = [gram_counts(t, letters) for t in batch.column("__text").to_pylist()]
                    known = np.array([f for _, f in pairs]) if model else np.zeros(len(pairs), bool)
                    lang, score, rejected = [UNKNOWN] * len(pairs), np.zeros(len(pairs)), ~known
                    if known.any():
                        best, s, far = model.nearest(np.stack([c for c, f in pairs if f]))
                        score[known], rejected[known] = s, far
                        for i, k in zip(np.flatnonzero(known), best):
                            lang[i] = model.langs[k]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(lang), pa.array(score), pa.array(rejected)], [*keep, "lang_pred", "score", "rejected"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in keep]).schema]
    return source.mapInArrow(run, ", ".join([*kinds, "lang_pred string, score double, rejected boolean"]))
