"""Every query of the catalog against its SQL."""

import pytest
from oracle import compare, connect

from tidewire import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(name, spark, sf_dir, con):
    compare(catalog.QUERIES[name](spark, sf_dir), con, catalog.SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["score_set", "key", "bucket", "n"]
