"""The opN queries whose result SQL can state, against DuckDB."""

import pytest

from quillspark.llm import queries

from .. import oracle


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, sf, name):
    names, got = oracle.rows_of(queries.QUERIES[name](spark, sf))
    want_names, want = oracle.rows_of_sql(oracle.connect(sf), queries.ORACLE[name])
    assert names == want_names
    assert got == want
