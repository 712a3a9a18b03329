import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    assert not differences(entry.queries()[name](spark, FOLDER), connect(FOLDER), entry.oracle_sql()[name])


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
