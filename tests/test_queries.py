"""Every query with SQL against DuckDB on the smallest tables; the contract of the entry module."""

import importlib
import importlib.util
import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from millrace import catalogue_queries, problem_queries

DATA = Path(os.environ.get("MILLRACE_TESTDATA", "/root/testdata/sf0.001"))
ORACLES = catalogue_queries.ORACLES | problem_queries.ORACLES
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, str(DATA))
    names = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in names] for r in df.collect()), key=repr)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    want = sorted(([plain(r[columns.index(c)]) for c in names] for r in result.fetchall()), key=repr)
    assert got == want


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_llm(monkeypatch):
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *more: None if name.startswith("millrace.llm") else real(name, *more))
    try:
        importlib.reload(entry)
        assert "p1_found" in entry.queries() and "p8_ids" not in entry.queries()
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


def test_core_never_imports_llm():
    root = Path(entry.__file__).parent / "millrace"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "millrace.llm" not in f.read_text(), f
