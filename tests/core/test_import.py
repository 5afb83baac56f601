"""The driver's functions need no session: queries are made when they are called."""

import subprocess
import sys


def test_entry_is_imported_without_a_session():
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    n, m = map(int, said.stdout.split())
    assert n >= m > 100
