"""The entry module stands without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_import_without_training_data_operators(tmp_path):
    shutil.copytree(ROOT / "recoflow", tmp_path / "recoflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and set(e.oracle_sql()) <= set(e.queries()) and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"}, timeout=120)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "recoflow").rglob("*.py"):
        if "llm" not in path.parts:
            assert "recoflow.llm" not in path.read_text()


def test_every_oracle_has_a_query():
    import __spark_entry__ as driver

    assert set(driver.oracle_sql()) <= set(driver.queries())
