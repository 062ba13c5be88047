"""The registered queries against DuckDB, and the entry point with and without the text operators."""

import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from fairlead.plans import registry

ROOT = Path(__file__).resolve().parent.parent
SQL = registry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(sf):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{sf}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_duckdb(spark, sf, duck, name):
    got, want = entry.queries()[name](spark, sf), duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    a = sorted(tuple(map(plain, r)) for r in got.select(*cols).collect())
    b = sorted(tuple(map(plain, r)) for r in want.select(*[f'"{c}"' for c in cols]).fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0


def test_flagship(spark):
    assert entry.entry(spark).count() == 1000


def test_works_without_the_text_operators(tmp_path):
    for p in ROOT.iterdir():
        if p.name in ("fairlead", "__spark_entry__.py"):
            (tmp_path / p.name).symlink_to(p) if p.is_file() else subprocess.run(["cp", "-r", p, tmp_path], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "fairlead/llm"], check=True)
    code = "import __spark_entry__ as e; n = e.queries(); assert len(n) > 50 and not any(x.startswith('op') for x in n) and 'pipeline' not in n; assert set(e.oracle_sql()) <= set(n)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
