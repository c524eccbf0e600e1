"""Every registered query against its DuckDB oracle on whole tables."""

import pytest

from tests.compare import compare, oracle_connection
from wrenchbook.plans.registry import all_queries


@pytest.fixture(scope="module")
def duck(data_dir):
    return oracle_connection(data_dir)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, duck, data_dir, name):
    problem, _ = compare(spark, duck, all_queries()[name], data_dir)
    assert problem is None


def test_entry_points(spark):
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert entry.entry(spark).columns == ["query_id", "rank", "document_id", "title", "section", "quote"]
