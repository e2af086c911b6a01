"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timelog.shared import shared_dir

#: ASCII white space, as a Java regular expression class body.
SPACE = " \\t-\\r"
#: Stands for a missing doc_id inside the operators: sorts after every other id.
NO_ID = (1 << 63) - 1


def words_count(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space; 0 for null."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " "))
    spaces = F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit("")))
    return F.when(squeezed == "", 0).otherwise(spaces + 1).cast("long")


def stored(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read again: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/timelog-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._timelog_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by `stored` that no later plan reads."""
    for df in tables:
        jvm, path = df.sparkSession._jvm, df._timelog_path
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that no live plan refers to any more.

    It learns of that only when the driver collects its garbage (twice for what
    has finalizers), which an idle driver does every half an hour. An operator
    of several passes would keep the shuffles of all of them on disk till then;
    it calls this once between two passes, never in a loop over data.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def scan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of `df`; for a file scan, the size of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def buckets(df: DataFrame, each: int = 4 << 20) -> int:
    """How many buckets keep the load of each in proportion to `each` bytes of input files, whatever the size of the input."""
    few = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(few, min(scan_bytes(df) // each, (1 << 31) - 1))


def byte_slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece has about `most` bytes of text, one row at least."""
    at, rows = 0, batch.num_rows
    if not rows:
        return
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    while at < rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as bytes; null becomes an empty text."""
    return column.cast(pa.large_binary()).fill_null(b"").to_pylist()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column as one array, and the start of each text, with the end."""
    texts = pa.concat_arrays([column.cast(pa.large_binary()).fill_null(b"")])
    starts = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def unnamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`df` with column names that clash with none of an operator's, and the new name of each old one."""
    new = [f"__c{n}" for n in range(len(df.columns))]
    return df.toDF(*new), dict(zip(df.columns, new))
