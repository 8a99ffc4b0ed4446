"""Every registered query runs, and matches its SQL in DuckDB where it has one."""

from __future__ import annotations

import pytest

import siltstone.queries  # noqa: F401
from siltstone import registry
from tests.conftest import DATA, same_rows


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(name, spark, duck):
    same_rows(registry.QUERIES[name](spark, DATA), duck, registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(name, spark):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_a_name_is_registered_once():
    with pytest.raises(ValueError):
        registry.register("flagship", lambda s, d: None)
