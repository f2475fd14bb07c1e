"""The driver's entry points, and every query with SQL against DuckDB."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from lodestone import queries as engine

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def same(x):
    return str(round(x, 9)) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_query_matches_sql(spark, db, name):
    got = engine.queries()[name](spark, SF)
    want = db.sql(engine.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(same(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(same(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(engine.queries()) <= set(entry.queries())


def test_rest_stands_without_the_training_data_subpackage(tmp_path):
    """A copy of the repository without that subpackage still imports and registers the engine's queries."""
    for p in ROOT.rglob("*.py"):
        rel = p.relative_to(ROOT)
        if "llm" not in rel.parts and rel.name != "corpus_pipeline.py" and not rel.parts[0].startswith("."):
            to = tmp_path / rel
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(p.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'knn_cosine' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
