"""Every registered query of the engine against its SQL on the smallest tables."""

import pytest

from loomspark.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(check_query, name):
    check_query(name, registry.queries()[name], registry.oracle_sql()[name])


def test_flagship_has_rows(spark):
    assert registry.flagship(spark, "/root/testdata/sf0.001").count() > 0
