"""The core queries load without the corpus subpackage and without the packages that it needs."""

import subprocess
import sys
from pathlib import Path

import pytest

from tidemark.plans import catalog

ROOT = str(Path(__file__).resolve().parent.parent)


@pytest.mark.parametrize("missing", ["xxhash", "tidemark.llm.catalog", "tidemark.llm"])
def test_core_queries_load_without(missing):
    code = (f"import sys; sys.modules[{missing!r}] = None; sys.path.insert(0, {ROOT!r}); import __spark_entry__ as e; "
            "print(len(e.queries()), len(e.oracle_sql()))")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, check=True)
    assert out.stdout.split() == [str(len(catalog.queries())), str(len(catalog.oracle_sql()))]
