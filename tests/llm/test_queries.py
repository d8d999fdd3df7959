"""The registered queries: SQL where there is some, and the driver's contract."""

import subprocess
import sys
from pathlib import Path

import pytest

from checks.compare import connect, differences
from skyledger.llm.queries import ORACLE, QUERIES

ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, sf, name):
    assert differences(QUERIES[name](spark, sf), connect(sf), ORACLE[name]) is None


def test_registered():
    import __spark_entry__ as contract

    names = set(contract.queries())
    assert {*QUERIES, "pipeline"} <= names and set(contract.oracle_sql()) <= names
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_nothing_else_imports_the_package():
    code = (
        "import sys; sys.modules['skyledger.llm'] = None; sys.modules['corpus_pipeline'] = None;"
        "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split()[-1] == "False"
