import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("missing", ["corpus_pipeline", "tessera.llm"])
def test_queries_without_the_training_data_part(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(len(e.queries()), [n for n in e.queries() if n.startswith(('op', 'pipeline'))])"
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout
    assert int(said.split()[0]) > 80 and said.rstrip().endswith("[]")


def test_other_missing_modules_are_errors():
    code = "import sys; sys.modules['tessera.config'] = None; import __spark_entry__"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode


def test_nothing_else_imports_the_training_data_part():
    for path in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text().lower(), path
