"""The entry module without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)


@pytest.mark.parametrize("missing", ["tracelantern.llm", "tracelantern.llm.queries", "corpus_pipeline", "xxhash"])
def test_other_queries_stay(missing):
    code = f"import sys; sys.path.insert(0, {ROOT!r}); sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    ran = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    names, sqls = ran.stdout.splitlines()
    assert "threat_score" in names.split() and "threat_score" in sqls.split()
    assert not [n for n in names.split() if n.startswith("op") or n == "pipeline"]
