import subprocess
import sys


def test_import_without_a_session():
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) - len(e.oracle_sql()))"], cwd=__file__.rsplit("/", 2)[0], capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
