"""Queries that SQL can express, against DuckDB; the others run and keep their contracts."""

import os
import zlib

import pytest

import check_queries as check
from latticeworks.llm.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    ok, message, _, _ = check.compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert ok, message


@pytest.mark.parametrize("name", ["op2_language_id", "op9_toxicity"])
def test_held_out_flag_and_every_row(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    ids = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    assert sorted(r.doc_id for r in rows) == sorted(ids)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_native_queries_have_no_python(spark):
    for name in ("op3_exact_dedup", "op10_license_scan"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
