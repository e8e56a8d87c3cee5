"""Plan shape: what Spark runs, not only what it returns."""

import pytest

import __spark_entry__ as E
from lakeledger.operators.profile import profile_all
from lakeledger.plans import registry
from lakeledger.sources import store
from lakeledger.sources.tables import driver_sources
from tests.conftest import SF_SMALL

registry.load_all()
CATALOGUE = registry.QUERIES  # the other queries are tested beside their operators

PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
            "PythonUDF", "MapInArrow")


def _plan(df, mode="formatted"):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


@pytest.mark.parametrize("name", sorted(CATALOGUE))
def test_no_python_in_any_query_plan(spark, name):
    plan = _plan(CATALOGUE[name](spark, SF_SMALL))
    assert not any(n in plan for n in PY_NODES), name


def test_profile_scans_each_source_once_after_execution(spark):
    p = profile_all(spark, driver_sources(spark, SF_SMALL), with_samples=True)
    p.collect()
    final = p._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in final


def test_samples_use_a_partial_window_group_limit(spark):
    plan = _plan(E.queries()["samples"](spark, SF_SMALL))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_point_lookup_reaches_the_parquet_scan(spark, tmp_path):
    root = str(tmp_path / "cat")
    from lakeledger.plans.fixtures import Fixtures
    store.save_columns(Fixtures(spark, SF_SMALL).fx_columns, root)
    plan = _plan(store.load_columns(spark, root, "brz_t9"))
    assert "PushedFilters: [IsNotNull(table_name), EqualTo(table_name,brz_t9)]" in plan


def test_projection_is_pruned_at_the_scan(spark):
    # layers of the stored tables need only the order key (name and layer are functions of it)
    plan = _plan(E.queries()["layers"](spark, SF_SMALL))
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan
    # the row count of every source reads no column at all
    assert "ReadSchema: struct<>" in _plan(E.queries()["scan_tables"](spark, SF_SMALL))
