from __future__ import annotations

import glob
import os
import subprocess
import sys

import duckdb
import pytest
from tracelake import queries as catalogue

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_against_sql(spark, sf, con, name):
    df = catalogue.queries()[name](spark, sf)
    columns = sorted(df.columns)
    want = con.execute(catalogue.oracle_sql()[name])
    order = [d[0] for d in want.description]
    assert sorted(order) == columns
    rows = [tuple(r[order.index(c)] for c in columns) for r in want.fetchall()]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r)) for r in df.select(*columns).collect())


def test_entry(spark):
    assert catalogue.entry(spark).count() > 0


def test_works_without_the_optional_parts(tmp_path):
    """A copy without the language-model folders still imports and lists the engine's own queries."""
    import shutil

    copy = tmp_path / "repo"
    shutil.copytree(os.path.join(ROOT, "tracelake"), copy / "tracelake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), copy)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [k for k in q if k.startswith('op')] and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, check=True, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_nothing_else_imports_the_optional_parts():
    for path in glob.glob(os.path.join(ROOT, "tracelake", "**", "*.py"), recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            with open(path) as f:
                assert "llm" not in f.read(), path
