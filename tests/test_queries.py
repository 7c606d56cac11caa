"""Every core query against its SQL, with types, on the small tables."""

import pytest

from conftest import SMALL
from harness import connect, differences
from quantmill.plans import core_queries


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(core_queries.oracle_sql()))
def test_sql(spark, duck, name):
    assert not differences(core_queries.queries()[name](spark, SMALL), core_queries.oracle_sql()[name], duck)


@pytest.mark.parametrize("name", sorted(set(core_queries.queries()) - set(core_queries.oracle_sql())))
def test_rows(spark, name):
    df = core_queries.queries()[name](spark, SMALL)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)
    assert any(r[c] is not None for r in rows for c in df.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
