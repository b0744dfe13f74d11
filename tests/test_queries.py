"""Every registered query of the reference's operators against DuckDB, or at least that it runs."""

import pytest

from quillspark import registry

from . import oracle


@pytest.fixture(scope="module")
def duck(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_sql(spark, sf, duck, name):
    names, got = oracle.rows_of(registry.QUERIES[name](spark, sf))
    want_names, want = oracle.rows_of_sql(duck, registry.ORACLE[name])
    assert names == want_names
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    df.write.format("noop").mode("overwrite").save()
    assert len(set(df.columns)) == len(df.columns)
