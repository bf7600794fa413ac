"""Every registered query against its DuckDB twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tools.compare import connect, difference
from voxelweave.queries import load_all

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def test_only_queries_too_long_for_sql_have_no_twin():
    queries, oracles = load_all()
    assert set(queries) - set(oracles) == {"training_chain"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    df = QUERIES[name](spark, SF)
    found = connect(SF).execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert difference(df.columns, [tuple(r) for r in df.collect()], columns, found.fetchall()) is None


def test_entry_has_one_row_per_case(spark):
    assert entry.entry(spark).count() == 25
