"""Every query of the core against its SQL, over whole tables."""

import pytest
from helpers import same_as_sql

from siltstone.plans.oracle import ORACLE
from siltstone.plans.registry import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, small, name):
    same_as_sql(QUERIES[name](spark, small), ORACLE[name], small)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_without_sql(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_no_python_in_the_plans(spark, small):
    for name in QUERIES:
        if name.startswith("q"):
            plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
            assert "Python" not in plan and "InPandas" not in plan and "CartesianProduct" not in plan, name


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["IS_COPY_AS_IMPORT", "PACKAGER_MANAGER_NAME", "n_files"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_only_an_absent_subpackage_is_left_out():
    import importlib.util
    import subprocess
    import sys
    from pathlib import Path

    run = lambda code: subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], capture_output=True, text=True)
    gone = run("import sys; sys.modules['siltstone.llm'] = None; import __spark_entry__ as e; print(len(e.queries()))")
    assert int(gone.stdout) == len(QUERIES), gone.stderr
    if importlib.util.find_spec("siltstone.llm"):
        # what the subpackage needs being absent is an error, not fewer queries
        broken = run("import sys; sys.modules['numpy.fft'] = sys.modules['regex'] = None; import __spark_entry__")
        assert broken.returncode and "ModuleNotFoundError" in broken.stderr
