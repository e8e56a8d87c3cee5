"""Every registered query against its DuckDB oracle (sf0.001)."""

import pytest

import __spark_entry__ as E
from lakeledger.plans import registry
from tests.conftest import SF_SMALL
from tools.check_oracle import rows_of

registry.load_all()
QUERIES = registry.QUERIES
ORACLE = registry.ORACLE


def test_every_query_but_approx_has_an_oracle():
    assert set(QUERIES) - set(ORACLE) == {"profile_approx"}
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    sp = QUERIES[name](spark, SF_SMALL).toPandas()
    dp = duck.execute(ORACLE[name]).df()
    assert sorted(sp.columns) == sorted(dp.columns)
    assert len(sp) == len(dp)
    assert rows_of(sp) == rows_of(dp)


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 63
    assert {"null_percentage", "distinct_count", "sample_values", "is_primary_key"} <= set(df.columns)
    assert all(r["distinct_count"] is not None for r in rows)
