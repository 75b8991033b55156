"""Every registered query that has SQL gives the same rows as its SQL."""

import pytest
from oracle import compare

from curata.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    compare(spark, catalog.queries()[name], catalog.oracle_sql()[name], sf_dir)


def test_png_queries_without_sql(spark, sf_dir):
    rows = catalog.queries()["png_repair"](spark, sf_dir).collect()
    assert all(r.broken == (r.vec_id % 2 == 0) for r in rows) and all(r.repaired for r in rows if r.broken)
    assert all(r.phash is not None for r in rows)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
