from __future__ import annotations

import duckdb
import pytest

from kunits.plans import knowledge_queries, operator_queries  # noqa: F401  register their queries
from kunits.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _rows(rows):
    shown = lambda v: round(v, 5) if isinstance(v, float) else str(v) if not isinstance(v, bool | int | str | type(None)) else v
    return sorted((tuple(map(shown, r)) for r in rows), key=repr)


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, db, name):
    want = db.sql(SQL[name])
    got = QUERIES[name](spark, SF)
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    quoted = ", ".join(f'"{c}"' for c in order)
    assert _rows(got.select(*order).collect()) == _rows(want.project(quoted).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("absent", [("llm", "corpus_pipeline.py"), ("llm",)])
def test_entry_survives_without_the_training_operators(tmp_path, absent):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", *absent, "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)
