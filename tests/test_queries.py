"""Every registered query against its SQL; the others must run and give rows."""

import pytest

from marginalia.plans import registry
from tests.compare import assert_same

registry.load()


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(name, spark, data):
    assert_same(registry.QUERIES[name], registry.SQL[name], spark, data)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(name, spark, data):
    assert registry.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
