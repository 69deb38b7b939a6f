"""Every query that has SQL, against that SQL."""

import pytest

from checks import all_queries
from checks.run_checks import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, SQL = all_queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, con, name):
    line = compare(name, spark, con, SF)
    assert line.startswith("ok") and "TYPES" not in line, line
