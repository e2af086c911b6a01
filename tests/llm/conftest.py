import pandas as pd
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (doc_id, text, lang, source) rows, with columns whose names the operators use inside."""

    def make(rows, extra=False):
        rows = [(r[0], r[1], *(r[2:] or ("en", "s")), len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(rows, SCHEMA)
        if extra:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit(c) for c in ("id", "th", "spans", "digest", "key", "size", "fp", "component", "n", "score", "bucket", "a", "b")})
        return df

    return make


@pytest.fixture(scope="session")
def sample(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def sample_rows(sample) -> pd.DataFrame:
    return sample.orderBy("doc_id").toPandas()
