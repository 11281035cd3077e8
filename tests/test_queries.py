"""Every registered query against its SQL, and the guard around the training-data subpackage."""

import datetime
import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = {k: v for k, v in entry.oracle_sql().items() if not k.startswith(("op", "pipeline"))}


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, datetime.datetime) and value.time() == datetime.time(0):
        value = value.date()
    return str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, oracle, name):
    got = entry.queries()[name](spark, SF)
    want = oracle.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_training_data_operators(tmp_path):
    """The rest imports and registers its queries where the subpackage and the pipeline are deleted."""
    root = Path(entry.__file__).parent
    code = f"""
import importlib.util, shutil, sys
shutil.copytree({str(root / 'pavilion')!r}, {str(tmp_path / 'pavilion')!r}, ignore=shutil.ignore_patterns('llm', '__pycache__'))
shutil.copy({str(root / '__spark_entry__.py')!r}, {str(tmp_path)!r})
sys.path[:] = [{str(tmp_path)!r}] + [p for p in sys.path if p not in ('', {str(root)!r})]
import __spark_entry__ as e
names = e.queries()
assert 'leaderboard_core' in names and not any(n.startswith(('op1_', 'pipeline')) for n in names)
assert not any(m.startswith('pavilion.llm') for m in sys.modules)
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, cwd=tmp_path)


@pytest.mark.parametrize("absent", ["pavilion.llm", "corpus_pipeline", "numpy", "pyarrow"])
def test_entry_where_something_cannot_be_imported(absent):
    code = f"""
import sys
sys.modules[{absent!r}] = None
import __spark_entry__ as e
names = e.queries()
assert 'leaderboard_core' in names and 'pipeline' not in names and set(e.oracle_sql()) <= set(names)
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, cwd=Path(entry.__file__).parent)
