"""Every query has the rows of its DuckDB counterpart."""

from __future__ import annotations

import pytest

from tests.conftest import same_rows
from tidemark import catalog
from tidemark.plans.review import QUERIES

SQL = catalog.oracle_sql()


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(name, spark, sf_dir, duck):
    assert same_rows(catalog.queries()[name](spark, sf_dir), duck, SQL[name]) > 0
