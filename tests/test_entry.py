"""The entry module is imported, and lists its queries, before there is a session."""

import subprocess
import sys
from pathlib import Path


def test_import_without_a_session():
    said = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert o.keys() <= q.keys(); print(len(q))"
    out = subprocess.run([sys.executable, "-c", said], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, check=True)
    assert int(out.stdout.split()[-1]) > 100
