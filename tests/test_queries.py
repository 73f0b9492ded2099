import pytest

from tests.oracle import check
from tidemill.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, name):
    check(spark, SF, QUERIES[name], ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
