"""Every registered query against the oracle engine, on whole tables."""

from __future__ import annotations

import pytest
from compare import differences, kinds

import __spark_entry__ as entry_points
from bookloom import catalog, oracle

QUERIES = catalog.queries()
ORACLE = oracle.all_sql()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, sf_dir, oracle):
    ours = QUERIES[name](spark, sf_dir).toPandas()
    theirs = oracle.sql(ORACLE[name]).df()
    assert differences(ours, theirs) is None
    if len(ours):
        assert kinds(ours) == kinds(theirs)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_entry_points_hold_the_catalog():
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(ORACLE) <= set(entry_points.oracle_sql())
