"""Each query over the log and over benchmark results equals its SQL; the others give rows."""

import pytest

import __spark_entry__
from kvlog.plans import catalogue
from kvlog.streaming import queries as streaming
from oracle import SF, holds

QUERIES, SQL = {**catalogue.QUERIES, **streaming.QUERIES}, {**catalogue.SQL, **streaming.SQL}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    if name in SQL:
        holds(spark, QUERIES[name], SQL[name])
    else:
        assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1000
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
