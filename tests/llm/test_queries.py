"""Queries of the llm package against their DuckDB SQL, and the pipeline."""

import pytest

from lakeledger.llm import registry
from tests.conftest import SF_SMALL
from tools.check_oracle import rows_of

registry.load_all()


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_oracle(spark, duck, name):
    sp = registry.QUERIES[name](spark, SF_SMALL).toPandas()
    dp = duck.execute(registry.ORACLE[name]).df()
    assert sorted(sp.columns) == sorted(dp.columns)
    assert rows_of(sp) == rows_of(dp)


def test_pipeline(spark):
    import corpus_pipeline as C
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    before = docs
    for name, stage in C.STAGES[:-1]:
        after = C.saved(stage(spark, before, SF_SMALL), f"test-{name}")
        assert after.columns == docs.columns
        assert after.exceptAll(before).isEmpty() and 0 < after.count() <= before.count()
        before = after
    pieces = C.run(spark, SF_SMALL)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in before.select("doc_id").collect()}
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "s", 0)], docs.schema)
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, odd, SF_SMALL).columns == docs.columns
        assert stage(spark, docs.where("false"), SF_SMALL).count() == 0
