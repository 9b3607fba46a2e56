"""Each registered query of the core against its SQL, on the smallest sample; and the core without the rest."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import colloom.plans.byte_queries  # noqa: F401
import colloom.plans.table_queries  # noqa: F401
from colloom.plans.catalogue import QUERIES, SQL

SAMPLE = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SAMPLE}/{t}.parquet'")
    return c


def plain(x):
    return round(float(x), 6) if isinstance(x, float) or hasattr(x, "as_tuple") else x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SAMPLE)
    want = duck.execute(SQL[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in want.description], want.fetchall())


def test_core_stands_alone(tmp_path):
    """Without the folders of the training-data operators all core queries are listed, and the entry imports."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "*.json", "*.md"))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 80 and set(s) <= set(q) and 'pipeline' not in q, len(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert not done.returncode, done.stderr
