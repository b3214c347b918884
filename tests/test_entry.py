"""The registry: every query has a name once, SQL only for known names, and small queries agree with their SQL."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORE = [n for m in entry.MODULES for n in m.R.queries]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test data")
@pytest.mark.parametrize("name", [n for n in CORE if n in entry.oracle_sql()])
def test_query_agrees_with_sql(spark, duck, name):
    found = entry.queries()[name](spark, DATA)
    names = sorted(found.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in found.collect()), key=repr)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == names
    want = sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in cursor.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("left", [(), ("__pycache__",)])
def test_the_rest_stands_without_the_training_data_operators(tmp_path, left):
    """A copy of the whole tree without the two llm folders still imports, with the other queries and their SQL; also if the
    folder stays with caches alone."""
    import shutil

    root = Path(entry.__file__).parent
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns("llm", "__pycache__", ".git", ".pytest_cache"))
    assert (tmp_path / "r/corpus_pipeline.py").exists()
    for name in left:
        (tmp_path / "r/capturelake/llm" / name).mkdir(parents=True)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'a03_view_edges' in q and 'pipeline' not in q and not any(k[2:3].isdigit() and k.startswith('op') for k in q) and set(s) <= set(q); print(len(q))"
    env = {"PATH": "/usr/bin:/bin", "HOME": "/tmp"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, env=env)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) == len(CORE)
    done = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q"], cwd=tmp_path / "r", capture_output=True, text=True, env=env)
    assert done.returncode == 0, done.stdout + done.stderr


def test_other_missing_modules_are_errors(monkeypatch):
    def missing(name):
        raise ModuleNotFoundError("no", name="somewhere.else")

    monkeypatch.setattr(entry.importlib, "import_module", missing)
    with pytest.raises(ModuleNotFoundError):
        entry.queries()
