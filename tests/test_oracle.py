"""Every registered core query against its SQL on the smallest tables."""

import pytest
from compare import connection, duck_rows, spark_rows

from mnemolake.plans.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    got = spark_rows(queries()[name](spark, SF))
    if name in oracle_sql():
        assert got == duck_rows(con, oracle_sql()[name])
    else:
        assert got[0]


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_without_the_optional_subpackage(monkeypatch):
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "mnemolake.llm.queries", None)
    assert set(__spark_entry__.queries()) == set(queries()) and "hybrid_recall" in __spark_entry__.oracle_sql()


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
