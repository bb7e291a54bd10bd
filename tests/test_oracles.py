"""Every query with an SQL form, next to that form, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check import compare, duck

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, con, name):
    ok, text = compare(spark, con, SF_DIR, name)
    assert ok, text


def test_every_sql_form_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
