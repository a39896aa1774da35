"""The registered cohort queries against their SQL, and the entry points."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import oracle
from cohortsmith.queries import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parent.parent
needs_data = pytest.mark.skipif(not oracle.THERE, reason="no tables")


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    oracle.same(spark, QUERIES[name], ORACLES[name])


@needs_data
def test_sampling_draws_the_share(spark):
    whole = QUERIES["or_group"](spark, oracle.FOLDER).count()
    assert QUERIES["sampled"](spark, oracle.FOLDER).count() == int(whole / 4 + 0.5)


def test_entry_points_without_the_subpackage(tmp_path):
    """The rest still imports and registers its queries when the training-data operators are gone."""
    shutil.copytree(ROOT / "cohortsmith", tmp_path / "cohortsmith", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'and_group' in q and 'pipeline' not in q and not any(n.startswith('op1') for n in q); assert set(e.oracle_sql()) <= set(q); print('fine')"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "fine", done.stderr


def test_an_error_inside_is_not_taken_for_an_absent_subpackage(tmp_path):
    shutil.copytree(ROOT / "cohortsmith", tmp_path / "cohortsmith", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert "no_such_module" in done.stderr
