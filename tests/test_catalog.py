"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    from tools.check_sql import duck

    return duck(FOLDER)


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    from tools.check_sql import rows

    df = queries()[name](spark, FOLDER)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in oracle_sql():
        rel = duck.execute(oracle_sql()[name])
        columns = [d[0] for d in rel.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows(columns, rel.fetchall())
