"""Every event-log query against its SQL counterpart, and that the others run."""

import pytest
from helpers import assert_same, rows_of, sql_rows

from timelog.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, sf_dir, duck):
    assert_same(rows_of(QUERIES[name](spark, sf_dir)), sql_rows(duck, ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0
