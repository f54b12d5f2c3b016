"""Every registered query against its SQL, or for its row count without one."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from tests.compare import compare, connect
from textloom.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        assert compare(df, duck.sql(SQL[name])) == []
    else:
        assert df.count() > 0


def test_every_key_has_an_inventory_id():
    for name in QUERIES:
        assert name.split("_")[0][0] in "abcdefghijkmn" or name == "flagship_keyness"
        assert not name.startswith("op") and "pipeline" not in name


def test_entry(spark):
    import __spark_entry__ as entry

    result = entry.entry(spark)
    assert result.count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("kept", [(), ("corpus_pipeline.py",)])
def test_entry_without_training_data(tmp_path, kept):
    """The entry imports in a copy of the library without that package."""
    root = Path(__file__).parent.parent
    shutil.copytree(root / "textloom", tmp_path / "textloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *kept):
        shutil.copy(root / name, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(k.startswith('op') for k in q), 'pipeline' in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert done.stdout.split() == [str(len(QUERIES)), "0", "False"]
