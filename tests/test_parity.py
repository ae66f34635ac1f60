"""Every registered query with SQL gives what DuckDB gives."""

from __future__ import annotations

import pytest

import tidemark.queries  # noqa: F401
from tests.parity import compare, connect
from tidemark import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_rows(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLE:
        assert compare(df, con, registry.ORACLE[name]) == ""
    else:
        assert df.count() >= 0
