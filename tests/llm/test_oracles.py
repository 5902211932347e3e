"""Queries of this subpackage against their SQL in DuckDB, and the guard that lets the rest live without it."""

import subprocess
import sys

import duckdb
import pytest

from marketlens.llm.queries import ORACLE_SQL, QUERIES

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    names = [c[0] for c in duck.sql(f"DESCRIBE {ORACLE_SQL[name]}").fetchall()]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in duck.sql(ORACLE_SQL[name]).fetchall()]
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, want))


def test_the_entry_module_lives_without_this_subpackage(tmp_path):
    import os
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(f"{root}/marketlens", tmp_path / "marketlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship_turnover' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
