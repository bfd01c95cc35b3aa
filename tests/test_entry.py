"""The driver's contract: registered queries against their SQL on the smallest tables, and imports without the llm folders."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from factgraph.plans import catalog

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def value(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, (int, float)):
        return round(float(x), 6)
    return tuple(map(value, x)) if isinstance(x, (list, tuple)) else str(x)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    rows = [tuple(value(r[c]) for c in columns) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted((tuple(map(value, r)) for r in want), key=repr)


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",)])
def test_runs_without_training_data_folders(tmp_path, left):
    """Without the llm folders, with or without the pipeline's file, the entry imports, and other queries and tests work."""
    gone = {"llm", "corpus_pipeline.py"} - set(left)
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", *gone, "__pycache__", "spark-warehouse", ".pytest_cache"))
    code = "import __spark_entry__ as e; n = e.queries(); assert len(n) > 80 and not any(x.startswith('op') and x[2].isdigit() or x == 'pipeline' for x in n); assert set(e.oracle_sql()) <= set(n)"
    env = {**os.environ, "PYTHONPATH": str(tmp_path / "repo")}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, check=True)
    if not left:
        subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "tests/test_entry.py", "-k", "keep_best or safe_names or gate_score"], cwd=tmp_path / "repo", env=env, check=True)


@pytest.mark.skipif(not os.path.isdir(os.path.join(ROOT, "factgraph", "llm")), reason="the folder is not there")
def test_an_import_error_inside_the_folder_is_not_swallowed(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", ".pytest_cache"))
    with open(tmp_path / "repo" / "factgraph" / "llm" / "__init__.py", "a") as f:
        f.write("\nimport no_such_module_at_all\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path / "repo", env={**os.environ, "PYTHONPATH": str(tmp_path / "repo")}, capture_output=True, text=True)
    assert done.returncode and "no_such_module_at_all" in done.stderr
