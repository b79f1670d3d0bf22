"""Every registered query against its SQL twin, and those without one for running and having rows."""

import pytest

from cuelake.jobs import registry

from .conftest import DATA


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_agrees_with_sql(name, agree):
    agree(registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(name, spark):
    assert registry.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
