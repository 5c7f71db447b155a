import duckdb
import pytest

from tessera.plans import catalogue, further  # noqa: F401  (both register their fixtures)
from tessera.plans.registry import FIXTURE_SQL, FIXTURES, QUERIES


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(FIXTURES))
def test_equals_its_sql(spark, name):
    assert name not in QUERIES
    made = FIXTURES[name](spark, "")
    found = made.collect()
    assert found
    if name in FIXTURE_SQL:
        told = duckdb.sql(FIXTURE_SQL[name])
        assert sorted(told.columns) == sorted(made.columns)
        assert rows(made.columns, [tuple(r) for r in found]) == rows(list(told.columns), told.fetchall())
