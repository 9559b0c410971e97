"""The entry points, with and without the optional training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 100
    if os.path.isdir(SF):
        assert e.entry(spark).count() > 0


def test_without_the_optional_part(tmp_path):
    for name in ("__spark_entry__.py", "brindle"):
        source = f"{TOP}/{name}"
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(source) else shutil.copy(source, tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()), 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    if out.returncode:
        pytest.fail(out.stderr[-500:])
    n, ops, pipeline = out.stdout.split()[-3:]
    assert int(n) > 100 and (ops, pipeline) == ("False", "False")
