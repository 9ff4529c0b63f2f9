"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry_module
from oracle import connect, difference
from workload import cleaning, files, linkage, noise, pages, sampling

# The queries of the library's own operators; those on training data have tests of their own.
MODULES = (cleaning, sampling, noise, linkage, pages, files)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLE)
    assert QUERIES.items() <= entry_module.queries().items()
    assert ORACLE.items() <= entry_module.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert difference(QUERIES[name](spark, sf_dir), con, ORACLE[name]) is None


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["id_a", "id_b", "score"]
    assert df.count() > 0
