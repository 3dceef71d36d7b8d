"""Every registered query against its SQL on the smallest tables; where those leave a result empty, on the next larger ones."""

import pytest

import __spark_entry__ as entry
from jobstrata import catalog
from tests.compare import compare, connect


LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.fixture(scope="module")
def larger_con():
    return connect(LARGER)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
    assert set(catalog.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, larger_con, sf_dir, name):
    problem = compare(spark, con, name, catalog.queries()[name], catalog.oracle_sql()[name], sf_dir)
    if problem == "EMPTY":  # equal, but says nothing: a place taken for a company needs more suppliers than the smallest tables have
        problem = compare(spark, larger_con, name, catalog.queries()[name], catalog.oracle_sql()[name], LARGER)
    assert problem == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0
