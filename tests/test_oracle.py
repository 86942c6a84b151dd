"""Every registered query with an SQL twin, compared value by value on the smallest tables."""

import pytest
from compare import compare, connect

from plumbline.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, sf, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], sf) == ""


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_the_rest_works_without_the_training_operators(tmp_path):
    """Entry points in a copy of the repository that lacks the optional subpackage."""
    import os
    import shutil
    import subprocess
    import sys
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("__spark_entry__.py", "plumbline"):
        source = os.path.join(here, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'metrics' in q and not any(n.startswith('op1') for n in q); assert set(e.oracle_sql()) <= set(q)"
    for with_pipeline in (False, True):
        if with_pipeline:
            (tmp_path / "corpus_pipeline.py").write_text("from plumbline.llm import quality\n")
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})
