import pytest

import __spark_entry__ as entry
from tests.oracle import compared

SF = "/root/testdata/sf0.001"
SQL = {k: v for k, v in entry.oracle_sql().items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_and_sql_agree(spark, name):
    got, want, names, own = compared(spark, entry.queries()[name], SQL[name], SF)
    assert names == own
    assert got == want
    assert len(got) > 0
