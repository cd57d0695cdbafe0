"""The driver contract: every query runs, and its SQL gives the same rows."""

import datetime
import decimal
import importlib
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
CORE = sorted(n for n in QUERIES if not QUERIES[n].__module__.startswith("formflow.llm"))


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in Path(small).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", CORE)
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    if name not in ORACLES:
        return
    r = duck.execute(ORACLES[name])
    columns = [d[0] for d in r.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    assert got == sorted(tuple(plain(row[i]) for i in order) for row in r.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_core_does_without_the_optional_package(monkeypatch):
    root = Path(entry.__file__).parent / "formflow"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert "formflow.llm" not in f.read_text() and "formflow import llm" not in f.read_text(), f
    real = importlib.import_module

    def missing(name, *args):
        if name == entry.OPTIONAL:
            raise ModuleNotFoundError(name)
        return real(name, *args)

    monkeypatch.setattr(importlib, "import_module", missing)
    assert sorted(entry.queries()) == CORE
