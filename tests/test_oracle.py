"""Every registered query against its SQL twin on the smallest tables; queries without a twin must give rows."""

import pytest

from __spark_entry__ import FLAGSHIP, entry, oracle_sql, queries
from check import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, TWINS = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    if name in TWINS:
        verdict, rows, _ = compare(df, duck, TWINS[name])
        assert verdict.startswith("ok"), verdict
    else:
        rows = len(df.collect())
    assert rows > 0 or name in MAY_BE_EMPTY


# The smallest tables hold no row these queries would keep.
MAY_BE_EMPTY = set()


def test_entry(spark):
    assert FLAGSHIP in QUERIES
    assert entry(spark).count() > 0
