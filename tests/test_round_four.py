"""Findings of the third round's report (FINDINGS_r03.md)."""

import os
import re

import pytest

import __spark_entry__ as E
from lakeledger.operators.report import export_nested, read_export, write_export
from lakeledger.plans import fixtures
from lakeledger.plans.fixtures import Fixtures
from lakeledger.sources.schema import COLUMNS_SCHEMA, TABLES_SCHEMA
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("name, shuffles", [("explode_replies", 1), ("fill_columns", 3), ("table_prompts", 1)])
def test_column_rows_are_dealt_in_tasks_of_bounded_size(spark, monkeypatch, name, shuffles):
    """Partitions grow with the rows, and grouping by table needs no further shuffle."""
    monkeypatch.setattr(fixtures, "ROWS_PER_TASK", 100)
    parts = -(-Fixtures(spark, SF_SMALL).table("lineitem").count() // 100)
    assert parts > 8
    plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(.*, (\d+)\), \w+", plan)
    assert len(dealt) >= shuffles and set(dealt) == {str(parts)}, dealt


def test_export_is_compressed_on_request_and_reads_back(spark, tmp_path):
    """the documents shrink; the rows read back are the same."""
    fx, sizes, rows = Fixtures(spark, SF_SMALL), [], []
    for how in (None, "gzip"):
        path = str(tmp_path / str(how))
        write_export(export_nested(fx.fx_tables, fx.fx_columns), path, compression=how)
        sizes.append(sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path) if f.startswith("part-")))
        rows.append(sorted(map(str, read_export(spark, path, TABLES_SCHEMA, COLUMNS_SCHEMA).collect())))
    assert rows[0] == rows[1] and len(rows[0]) == fx.fx_tables.count()
    assert sizes[1] * 4 < sizes[0]
