"""From raw documents to a training mix: quality, exact copies, near copies, benchmark leaks, source weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from timelog.llm import decontam, exact, mixing, quality, simhash
from timelog.llm.common import discard, docs_of, stored

#: Documents that score below it are rejected.
MIN_QUALITY = 0.3
#: Benchmark words in a row that a document may have: one less than a window.
MOST_HIT = 9
#: The share of a document's words that short benchmark items may cover.
MOST_COVERED = 0.5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model doesn't reject. The model learns from the labels outside the held-out fold.

    Null and empty texts are scored as empty ones; every row is judged by its
    own text, so repeated rows and ids stay or go each on its own. Without
    labels nothing is rejected.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_quality(docs, model, MIN_QUALITY)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the most code points, then the least id, null last.

    Null and empty texts and those of white space alone are equal; of rows that
    agree in id and text one stays.
    """
    return exact.drop_copies(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked texts, five-word near copies included: the least id, null last, then the least hash of the text.

    Texts without words are one component. Ids may repeat or be null with unlike
    texts: rows are told apart by both; of rows that agree in both one stays.
    """
    return simhash.one_of_each(docs, wide=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word benchmark window, and with no more than half of their words in benchmark items of fewer words.

    An item of one common word so costs no document that merely has it. Null and
    empty texts stay, and so do repeated rows.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.decontaminate(docs, items, max_words=MOST_HIT, max_coverage=MOST_COVERED)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, each row once, with how often (copies) and the words that makes (taken).

    Texts without words are never taken. Rows that agree in id, source and size
    tie; if the cut falls on them, as many as are needed are taken. A column
    named as one of the new ones comes back as <name>_in.
    """
    return mixing.mixed(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", simhash_dedup),
    ("benchmark decontamination", decontamination),
    ("source mixing", source_mix),
]

#: The quality model has no SQL form; tests hold every stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; each result is written as Parquet and read again, and then the one before it is deleted.

    An empty table gives an empty result with the columns of the last stage.
    """
    docs, last = docs_of(spark, sf_dir), None
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        if last is not None:
            discard(last)
        last = docs
    return docs
