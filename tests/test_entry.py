"""The driver's entry works with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
LIST = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"


def listed(folder) -> tuple[set, set]:
    done = subprocess.run([sys.executable, "-B", "-c", LIST], cwd=folder, capture_output=True, text=True, check=True)
    queries, statements = done.stdout.splitlines()[-2:]
    return set(queries.split()), set(statements.split())


@pytest.fixture
def copied(tmp_path):
    folder = tmp_path / "repo"
    shutil.copytree(ROOT, folder, ignore=shutil.ignore_patterns(".git", "llm", "tests", "__pycache__", "corpus_pipeline.py"))
    return folder


def test_without_the_corpus_operators(copied):
    from contract import oracle, registry

    assert listed(copied) == (set(registry.QUERIES), set(oracle.statements()))


def test_a_broken_corpus_module_is_an_error(copied):
    (copied / "corpus_pipeline.py").write_text("import a_module_that_does_not_exist\n")
    with pytest.raises(subprocess.CalledProcessError):
        listed(copied)


def test_nothing_else_imports_the_corpus_operators():
    for path in [*ROOT.glob("mercato/**/*.py"), *ROOT.glob("contract/*.py"), ROOT / "bench.py"]:
        if "llm" not in path.parts:
            assert "mercato.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path


def test_the_whole_tree_can_be_collected():
    """Helpers live outside conftest files, so tests of both folders can be collected in one run."""
    found = subprocess.run(
        [sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=ROOT, capture_output=True, text=True, timeout=300
    )
    assert found.returncode == 0, found.stdout[-2000:]
