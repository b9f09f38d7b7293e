"""Queries against their SQL, at the smallest scale."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from stratalint import queries, tree_queries

SQL = queries.oracle_sql()
TREES = sorted(tree_queries.QUERIES)


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def _rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(str, df.astype(object).where(df.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", ["high_complexity", "unused_import", "magic_string", "god_class", "missing_else", "lazy_class", "magic_number", "scope_mutation", "message_chain", "import_cycle", "import_edges", "suppression", "duplicate_function_body", "health_score", "scan_counters"])
def test_query(spark, sf, tables, name):
    assert _rows(queries.queries()[name](spark, sf).toPandas()) == _rows(tables.execute(SQL[name]).df())


@pytest.mark.parametrize("name", ["whole_scan", "remediation_plan", "severity_counts", "plan_files", "high_coupling"])
def test_whole_scan(spark, sf, tables, name):
    """With the default limits, repeated bodies are among a scan's issues, and in its score and plan."""
    assert _rows(queries.queries()[name](spark, sf).toPandas()) == _rows(tables.execute(SQL[name]).df())
    assert tables.execute(f"SELECT count(*) FROM ({SQL['whole_scan']}) WHERE rule = 'duplicate-function-body'").fetchone()[0] > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", TREES)
def test_sources_and_reports(spark, sf, tables, name):
    assert _rows(queries.queries()[name](spark, sf).toPandas()) == _rows(tables.execute(SQL[name]).df())
