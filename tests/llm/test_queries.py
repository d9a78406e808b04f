"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from interviewflow.llm.queries import ORACLES, QUERIES

TABLES = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "conversations", "benchmark"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{TABLES}/{table}.parquet'")
    df = QUERIES[name](spark, TABLES)
    want = db.execute(ORACLES[name])
    assert df.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("name", ["op1_secrets", "op7_quality", "op8_pii", "op9_chat"])
def test_native_queries_run_no_python(spark, name):
    plan = QUERIES[name](spark, TABLES)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
