"""The operators marked native run no Python on the executors, join nothing crosswise and gather no group."""

import pytest

from lodestack.llm import registry


@pytest.mark.parametrize("name", ["op3_url_filter", "op4_tool_calls", "op7_secrets", "op9_sharding", "op10_licenses"])
def test_native_plans(spark, small, name):
    text = registry.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in text


def test_each_operator_has_a_query(spark):
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES)
    assert numbers == list(range(1, 11))


def test_the_library_does_without(tmp_path):
    """Without these folders and the pipeline, the entry points and the other queries still import."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=copy, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}).returncode == 0
