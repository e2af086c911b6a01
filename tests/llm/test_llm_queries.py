"""The registered queries: against SQL where there is some, and that they cover every row."""

import pytest
from helpers import assert_same, rows_of, sql_rows

from timelog.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, sf_dir, duck):
    assert_same(rows_of(QUERIES[name](spark, sf_dir)), sql_rows(duck, ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_one_row_each(name, spark, sf_dir):
    table = "pages" if name == "op3_url_filter" else "documents"
    assert QUERIES[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
