"""Every named query against its DuckDB oracle."""

import pytest
from check_parity import compare
from conftest import SAMPLE

from topicpulse.plans.registry import catalogue


@pytest.mark.parametrize("name", list(catalogue()))
def test_query_matches_oracle(name, spark, duckdb_sample):
    _, rows, problem = compare(spark, duckdb_sample, catalogue()[name], SAMPLE)
    assert problem is None
    assert rows > 0


def test_flagship_is_registered():
    import __spark_entry__ as entry

    assert entry.FLAGSHIP in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
