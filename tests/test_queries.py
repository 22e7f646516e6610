"""Every registered query against its SQL counterpart, and the entry contract."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from compare import duck_rows, spark_rows
from scoreloom.catalogue import QUERIES
from scoreloom.oracles import ORACLES


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry_registers_them():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("absent", ["scoreloom.llm", "corpus_pipeline", "public_tokenizers"])
def test_entry_without_what_may_be_missing(absent):
    """The library's own queries register whether or not the text subpackage, or a package it needs, is there."""
    import os
    import subprocess
    import sys

    script = f"""
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name == {absent!r} or name.startswith({absent!r} + "."):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as entry
from scoreloom.catalogue import QUERIES
print(set(QUERIES) <= set(entry.queries()) and "pipeline" not in entry.queries())
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, cwd=root, env={**os.environ, "PYTHONPATH": f"{root}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"})
    assert done.stdout.strip() == "True", done.stderr[-2000:]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["vec_id", "pred", "score"]
    assert df.count() == 500


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, sf_dir, name):
    columns, rows = spark_rows(QUERIES[name](spark, sf_dir))
    expected_columns, expected = duck_rows(sf_dir, ORACLES[name])
    assert columns == expected_columns
    assert len(rows) == len(expected)
    assert rows == expected
