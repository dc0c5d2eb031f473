"""Every registered query of the core against its SQL on the same tables."""

import compare
import pytest

from taxolink.plans import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf_dir, con, name):
    assert compare.difference(QUERIES[name](spark, sf_dir), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 2
    assert set(e.oracle_sql()) <= set(e.queries())


def test_library_as_one_file(tmp_path):
    """What is sent to executors can be imported without this folder."""
    import subprocess
    import sys

    import __spark_entry__ as e

    code = f"import sys; sys.path.insert(0, {e._shipped()!r}); import taxolink.operators.match as m; assert '.zip' in m.__file__; print(sorted(m.MODES))"
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}
    assert "seqratio" in subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout
